"""Best-fit packing (operator 9): documents into token sequences of a fixed size, by best fit and local search.

Only texts longer than a sequence are cut, from the end, so that their first piece may be shorter; a piece of full size
is a sequence of its own. The rest is dealt by hash into groups of about ``GROUP`` pieces. A task packs a group by best
fit and improves that by moves, one-for-one and two-for-one exchanges between underfull bins that raise the sum of
squared fills, until a pass over all of them empties no bin. Best fit starts from the longest piece; where that
leaves more than ``GAP`` above the least number of bins that there can be, from a shuffled order as well, which is looser and
gives the search more room, and the better result counts. Bins that stay below ``KEEP`` of their size are opened and dealt
again in other mixtures, until one group is left or ``ROUNDS`` are over: the waste does not grow with the number of
groups, and what no mixture fills (pieces of six tenths of a sequence, say) stays as it is.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

GROUP, KEEP, ROUNDS, GAP = 16384, 0.98, 6, 0.002
#: Spans kept with their ids in a worker before it starts anew.
MEMO = 400_000
#: Characters taken at a time from a long text.
CHUNK = 1 << 20
#: Texts in which a blank or a line feed always starts a new span: no other white space, and none at an end or doubled.
_UNEVEN = re.compile(r"[^\S \n]|\s\s|^\s|\s$|\x00")


class _Memo(dict):
    """Little-endian 32-bit ids of spans, encoded when first met."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, span: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[span] = ids = array("I", self.encode(span)).tobytes()
        return ids


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary's byte strings if merging by ids is merging by the list of merges, else None."""
    vocab = model["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves
    other = [b for b in range(256) if b not in plain]
    of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ids = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
    if ids != sorted(set(ids)) or ids[:1] == [-1] or any(ch not in of_char for word in vocab if vocab[word] <= ids[-1] for ch in word):
        return None
    return {bytes(of_char[ch] for ch in word): i for word, i in vocab.items() if i <= ids[-1]}


@functools.cache
def encoder(path: str):
    """text -> little-endian unsigned 32-bit ids, as the tokenizer file at ``path`` gives without added special tokens.

    A plain byte-level BPE is split into spans whose ids are remembered; encoding is independent between spans. Other
    tokenizers, and texts that hold the string of an added token, go whole through the tokenizers library."""
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = lambda text: array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    pre = spec.get("pre_tokenizer") or {}
    ranks = _byte_ranks(spec["model"]) if spec["model"].get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") else None
    if not ranks:
        return slow
    spans = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("spans", pat_str=spans, mergeable_ranks=ranks, special_tokens={})
    memo = _Memo(fast.encode_ordinary)
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def encode(text: str) -> bytes:
        if any(t in text for t in added):
            return slow(text)
        if _UNEVEN.search(text):
            return array("I", fast.encode_ordinary(text)).tobytes()
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + CHUNK)
            end = len(text) if end < 0 else end
            out += map(memo.__getitem__, filter(None, text[at:end].replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
            at = end
        return b"".join(out)

    return encode


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's text, null as empty, each followed by ``end_id``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview(encode(text or "") + end)
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                out += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int, order: list[int] | None = None) -> list[list[int]]:
    """Bins of item numbers by best fit in an order (default: decreasing lengths). Open bins are found by their free space
    in a bit mask."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if order is None else order:
        need = lengths[item]
        fits = mask >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, at = size, len(bins)
            bins.append([])
        bins[at].append(item)
        left = space - need
        if left:
            free[left].append(at)
            mask |= 1 << left
    return bins


class _Partners:
    """Underfull bins by what they take: ``reach[y]`` is the largest length that may replace an item of length y (0: none)
    in one of them."""

    def __init__(self, bins: list[list[int]], lengths: list[int], fill: list[int], size: int):
        self.bins, self.lengths, self.fill, self.size = bins, lengths, fill, size
        self.version = [0] * len(bins)
        self.tops: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        self.reach = np.full(size + 1, -1)

    def _sizes(self, b: int) -> set[int]:
        return {0, *(self.lengths[i] for i in self.bins[b])}

    def add(self, b: int) -> None:
        free = self.size - self.fill[b]
        if free:
            for y in self._sizes(b):
                heapq.heappush(self.tops[y], (-(y + free), b, self.version[b]))
                self.reach[y] = max(self.reach[y], y + free)

    def remove(self, b: int) -> None:
        self.version[b] += 1
        for y in self._sizes(b):
            top = self.tops[y]
            while top and top[0][2] != self.version[top[0][1]]:
                heapq.heappop(top)
            self.reach[y] = -top[0][0] if top else -1

    def best(self, a: int) -> tuple[list[int], int, int] | None:
        """The step that takes most from bin a: lengths that leave it, the length that comes back (0: none), and the bin
        that they are exchanged with."""
        count: dict[int, int] = {}
        for i in self.bins[a]:
            count[self.lengths[i]] = count.get(self.lengths[i], 0) + 1
        own = np.array(sorted(count))
        i, j = np.triu_indices(len(own))
        two = (i != j) | (np.array([count[x] for x in own.tolist()])[i] > 1)
        out = np.concatenate((own, own[i[two]] + own[j[two]]))
        back = np.searchsorted(np.maximum.accumulate(self.reach), out)  # the least length that may be replaced
        gain = np.where(back < out, out - back, 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            return None
        k2 = k - len(own)
        lengths = [int(own[k])] if k2 < 0 else [int(own[i[two][k2]]), int(own[j[two][k2]])]
        return lengths, int(back[k]), self.tops[int(back[k])][0][1]


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search over all underfull bins, the emptiest first: move an item, exchange one for one, or two for one, with
    any bin that is at least as full and has the space, the step that takes most first. Each step raises the sum of squared
    fills; a bin that loses its last item goes. Passes go on until one empties no bin."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    emptied = True
    while emptied:
        emptied = False
        order = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < size), key=lambda k: (fill[k], k))
        partners = _Partners(bins, lengths, fill, size)
        for k in order:
            partners.add(k)
        for a in order:
            partners.remove(a)
            while bins[a] and fill[a] < size and (step := partners.best(a)):
                out, back, b = step
                partners.remove(b)
                gone = []
                for x in out:
                    gone.append(next(i for i in bins[a] if lengths[i] == x))
                    bins[a].remove(gone[-1])
                came = [next(i for i in bins[b] if lengths[i] == back)] if back else []
                bins[a] += came
                bins[b] = [i for i in bins[b] if i not in came] + gone
                gain = sum(out) - back
                fill[a], fill[b] = fill[a] - gain, fill[b] + gain
                partners.add(b)
            emptied |= not bins[a]
    return [b for b in bins if b]


def packed_bins(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: best fit and local search, from one or two starts."""
    bins, least = improve(best_fit(lengths, size), lengths, size), -(-sum(lengths) // size)
    if len(bins) - least > GAP * least:
        order = np.random.Generator(np.random.PCG64(29)).permutation(len(lengths)).tolist()
        bins = min(bins, improve(best_fit(lengths, size, order), lengths, size), key=len)
    return bins


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs (doc_id, text;
    more columns are ignored).

    A null or empty text is one piece that holds the end id. Rows with null or repeated doc_ids are packed row by row
    like any other; an empty table gives an empty result."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    known = cut(pieces(docs, tokenizer, size, end_id))
    done = known.filter(F.col("length") == size).select(*cols, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = known.filter(F.col("length") < size)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"

    for turn in range(ROUNDS):
        groups = max(1, -(-open_.count() // GROUP))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            dealt = (int(group["turn"].iloc[0]) << 30) + int(group["g"].iloc[0])
            group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            lengths = group["length"].tolist()
            order, sequence, offset, fill = [], [], [], []
            for k, items in enumerate(packed_bins(lengths, size)):
                at = 0
                for i in items:
                    order.append(i)
                    sequence.append((dealt << 20 | k) * 2)
                    offset.append(at)
                    at += lengths[i]
                fill += [at] * len(items)
            out = group.iloc[order][cols].reset_index(drop=True)
            return out.assign(sequence_id=sequence, offset=offset, fill=fill).astype({"doc_id": "Int64"})

        packed = cut(open_.select(*cols, F.lit(turn).alias("turn"), F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)).alias("g")).groupBy("g").applyInPandas(run, schema))
        last = groups == 1 or turn == ROUNDS - 1
        done = done.unionByName((packed if last else packed.filter(F.col("fill") >= KEEP * size)).drop("fill"))
        if last:
            break
        open_ = packed.filter(F.col("fill") < KEEP * size)
    return done
