"""SentencePiece encoding and decoding (operator 2) by streaming Viterbi.

Each boundary between characters has one surviving backpointer: the last piece of the segmentation that survives there.
For a unigram model it is that of the greatest sum of scores. For a BPE model, whose scores are ranks of merges and no
log-probabilities, it is the last piece of what the model's own encoder makes of the text so far: there is just one, and
it is known from the piece before it, as a sequence is what merging gives if and only if each two neighbours in it are
what merging the two gives. So both kinds of model get the ids that the model's own encoder gives.

A stream holds a window and commits ids whenever all surviving paths run through one boundary. Equal sums are settled for
the shorter last piece, so that runs of one character converge as well. Should a window of ``WINDOWS`` longest pieces
not converge, the first half of the path that survives at its end is committed and the rest begins anew there, as if
the text did (a forced commit; the text still comes back). So the memory that a text takes beside its ids does not grow
with its length. A boundary that every path shares whatever comes next, as that before a word, ends a span; what the
stream commits for a span is remembered, so a common word is walked through once.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import free_name

SPACE = "▁"
#: Spans of at most SPAN characters are remembered, MEMO of them, in a worker; and PAIRS neighbouring pieces.
MEMO, SPAN, PAIRS = 700_000, 48, 500_000
#: Documents whose ids a task hands over at a time.
BATCH = 500
#: Characters taken in between two looks for a common boundary; longest pieces that a window holds.
LOOK, WINDOWS = 64, 64
#: In place of an id: bytes of a character that no piece has.
NONE = 1 << 31


class _Memo(dict):
    """Committed ids of spans by the span, streamed when first met, with ``mark`` in front."""

    def __init__(self, mark: str, stream: Callable[[str], bytes]):
        self.mark, self.stream = mark, stream

    def __missing__(self, span: str) -> bytes:
        ids = self.stream(self.mark + span)
        if len(span) <= SPAN:
            if len(self) >= MEMO:
                self.clear()
            self[span] = ids
        return ids


class Stream:
    """Takes normalised text in parts and gives ids as early as all surviving paths agree on them. ``merges``: by the
    rule of a BPE model, else by the best sum of scores."""

    def __init__(self, codec: Codec, merges: bool):
        self.codec, self.merges = codec, merges
        self.step = self._merge if merges else self._sum
        self.longest, self.limit = codec.longest, WINDOWS * codec.longest
        self.held = self.forced = 0
        self._begin("")

    def _begin(self, window: str) -> None:
        n = len(window)
        #: window: characters not committed yet; by boundary: where its last piece starts, that piece's id (NONE: an
        #: unknown character, or the begin), and its sum of scores; done: the boundary up to which all that is known.
        self.window, self.done = window, 0
        self.back, self.ids = [-1] * (n + 1), [-1] * (n + 1)
        self.back[0], self.ids[0] = 0, NONE
        if not self.merges:
            self.best: list = [0.0, *[None] * n]

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), LOOK):
            part = text[at : at + LOOK]
            self.window += part
            for row, none in ((self.back, -1), (self.ids, -1), *([] if self.merges else [(self.best, None)])):
                row += [none] * len(part)
            self.held = max(self.held, len(self.window))
            self._walk()
            self._commit(out)
            if len(self.window) > self.limit:
                self._force(out)
        return out

    def close(self) -> list[int]:
        """The ids of what is left."""
        self._walk()
        return self._path(len(self.window))

    def _walk(self) -> None:
        """Find the survivors at the boundaries after ``done``."""
        if len(self.window) > self.done:
            self.step(self.done, self.codec.pieces.iter(self.window, max(0, self.done - self.longest + 1)))
            self.done = len(self.window)

    def _sum(self, done: int, met: Iterator[tuple[int, tuple[int, int, float]]]) -> None:
        """The best sum survives; met: where a piece ends, and its length, id and score, in order."""
        best, back, ids, unknown = self.best, self.back, self.ids, self.codec.unknown
        for end, (size, i, score) in (*met, (len(self.window), (0, 0, 0.0))):
            while done < end:  # no more pieces end at done + 1
                if best[done + 1] is None or best[done] + unknown > best[done + 1]:
                    best[done + 1], back[done + 1], ids[done + 1] = best[done] + unknown, done, NONE
                done += 1
            start = end + 1 - size
            if size and start >= 0 and end == done and (best[end + 1] is None or best[start] + score >= best[end + 1]):
                best[end + 1], back[end + 1], ids[end + 1] = best[start] + score, start, i

    def _merge(self, done: int, met: Iterator[tuple[int, tuple[int, int, float]]]) -> None:
        """The one piece survives that merging keeps behind the survivor before it."""
        back, ids, pairs, fits = self.back, self.ids, self.codec.pairs.get, self.codec.fits

        def unknown(at: int) -> None:  # characters up to ``at`` that no piece is
            while back[at] < 0:
                back[at], ids[at] = at - 1, NONE
                at -= 1

        for end, (size, i, _) in met:
            end += 1
            if back[end] >= 0 or size > end:
                continue
            start = end - size
            if back[start] < 0:
                unknown(start)
            before = ids[start]
            ok = pairs(before << 32 | i)
            if fits(before, i) if ok is None else ok:
                back[end], ids[end] = start, i
        for at in range(done + 1, len(back)):
            if back[at] < 0:
                unknown(at)

    def _commit(self, out: list[int]) -> None:
        """Commit up to the last boundary that all paths share: the next piece begins less than a longest one before the
        window's end."""
        back = self.back
        alive = set(range(max(0, self.done + 1 - self.longest), self.done + 1))
        while len(alive) > 1:  # step back from the farthest until all paths meet
            far = max(alive)
            alive.remove(far)
            alive.add(back[far])
        at = alive.pop()
        if at > 0:
            out += self._path(at)
            self.window, self.done = self.window[at:], self.done - at
            self.back, self.ids = [0, *(b - at for b in back[at + 1 :])], self.ids[at:]
            self.ids[0] = self.ids[0] if self.merges else NONE
            if not self.merges:
                self.best = [x - self.best[at] for x in self.best[at:]]

    def _force(self, out: list[int]) -> None:
        at = self.done
        while at > len(self.window) // 2:
            at = self.back[at]
        out += self._path(at)
        self.forced += 1
        self._begin(self.window[at:])
        self._walk()

    def _path(self, end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            start, i = self.back[end], self.ids[end]
            out += [i] if i != NONE else [self.codec.bytes[b] for b in reversed(self.window[start:end].encode("utf-8", "replace"))]
            end = start
        return out[::-1]


class Codec:
    """Encoder and decoder for a model file. Only models without a normalisation table, with a dummy prefix, escaped
    white space and byte fallback are taken; others are refused."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.bytes) < 256 or model.encode("a  Ａ", out_type=str)[0][0] != SPACE or model.decode(model.encode("a  Ａ")) != "a  Ａ":
            raise ValueError(f"{path}: only models with byte fallback and without normalisation are supported")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.piece = {i: model.id_to_piece(i) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.table = [bytes([self.byte_of[i]]) if i in self.byte_of else self.piece.get(i, "").encode() for i in range(n)]
        self.scored = {p: (model.get_score(i), i) for i, p in self.piece.items()}
        self.rank = {p: -score for p, (score, _) in self.scored.items()}
        self.unknown = min(s for s, _ in self.scored.values()) - 10.0
        self.longest = max(map(len, self.scored))
        #: Finds all pieces in a text: length, id, score.
        self.pieces = ahocorasick.Automaton()
        for p, (score, i) in self.scored.items():
            self.pieces.add_word(p, (len(p), i, score))
        self.pieces.make_automaton()
        #: No piece runs across a word's start or a line's end: every path has a boundary there.
        self.apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.scored)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        #: Whether ids come by merges (BPE) or by the best sum of scores (unigram).
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if proto.trainer_spec.model_type not in (proto.trainer_spec.BPE, proto.trainer_spec.UNIGRAM):
            raise ValueError(f"{path}: only BPE and unigram models are supported")
        if self.merges and any(x.type in (x.USER_DEFINED, x.UNUSED) for x in proto.pieces):
            raise ValueError(f"{path}: BPE models with user-defined or unused pieces are not supported")
        #: Neighbours within a piece; no merge joins others.
        self.near = {p[k : k + 2] for p in self.scored for k in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.streams = {by: Stream(self, by) for by in (True, False)}
        self.memos = {by: (_Memo(SPACE, streamed), _Memo("", streamed)) for by in (True, False) for streamed in [functools.partial(self._streamed, by)]}
        self.line = array("I", [self.bytes[10]]).tobytes()

    def _merged(self, span: str) -> list[str]:
        """The pieces that merging makes of a short span: of the neighbours that make up a piece always those of the
        best score, of equal ones the leftmost."""
        parts, rank, none = list(span), self.rank.get, float("inf")
        cost = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while cost and (low := min(cost)) < none:
            k = cost.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del cost[k]
            if k < len(cost):
                cost[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                cost[k - 1] = rank(parts[k - 1] + parts[k], none)
        return parts

    def fits(self, before: int, i: int) -> bool:
        """Whether merging a text that it makes ``before`` the last piece of (NONE: nothing that merges), with piece i
        behind it, keeps both. What was found is remembered in ``pairs``."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        piece = self.piece[i]
        if before != NONE and self.piece[before][-1] + piece[0] in self.near:
            kept = self._merged(self.piece[before] + piece) == [self.piece[before], piece]
        else:
            kept = self._merged(piece) == [piece]
        self.pairs[before << 32 | i] = kept
        return kept

    def stream(self, chars: Iterable[str], merges: bool = False) -> Iterator[int]:
        """Ids of normalised text given in parts, committed as early as all paths agree."""
        stream = Stream(self, merges)
        for part in chars:
            yield from stream.feed(part)
        yield from stream.close()

    def _streamed(self, merges: bool, span: str) -> bytes:
        if len(span) <= LOOK:  # a window of its own
            self.streams[merges]._begin(span)
            return array("I", self.streams[merges].close()).tobytes()
        stream = Stream(self, merges)
        return array("I", stream.feed(span) + stream.close()).tobytes()

    def encode(self, text: str, merges: bool = False) -> bytes:
        """Little-endian unsigned 32-bit ids of a text's segmentation of the best sum of scores, or by merges, without
        control ids."""
        if not text:
            return b""
        memo, heads = self.memos[merges]
        if not self.apart:
            return self._streamed(merges, SPACE + text.replace(" ", SPACE))
        if text[0] == " " or "  " in text or SPACE in text:
            return b"".join(map(heads.__getitem__, re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", SPACE + text.replace(" ", SPACE))))
        out: list[bytes] = []
        known = memo.__getitem__
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out += (self.line, heads[words[0]])
                out += map(known, words[1:])
            else:
                out += map(known, words)
        return b"".join(out)

    def own(self, text: str) -> bytes:
        """The ids that the model's own encoder gives."""
        return self.encode(text, self.merges)

    def decode(self, ids: bytes) -> str:
        """The text of ids; control ids are left out, bytes that are not UTF-8 become U+FFFD."""
        out = b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, into: str = "ids") -> DataFrame:
    """All columns of docs (with a column text) and the ids as ``into``, an array<int> (with underscores behind it if
    docs has such a column); null texts have null ids, empty ones none."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(model)
        return pd.Series([None if t is None else np.frombuffer(own.own(t), "<i4") for t in texts], dtype=object)

    return docs.withColumn(free_name(docs, into), ids("text"))


def decode(docs: DataFrame, model: str, into: str = "decoded") -> DataFrame:
    """All columns of docs (with a column ids, array<int>) and the texts as ``into`` (with underscores behind it if docs
    has such a column); null ids decode to null."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        own = codec(model)
        return pd.Series([None if x is None else own.decode(array("I", x).tobytes()) for x in ids], dtype=object)

    return docs.withColumn(free_name(docs, into), decoded("ids"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, decoded_crc32, exact) for each row of docs (doc_id, text; more columns are
    ignored): ``exact`` tells whether decoding gives the text back. A null text has null ids and decodes to null, an
    empty one has no ids; U+2581 in a text decodes to a blank, and so does not come back. Repeated rows are all encoded;
    an empty table gives an empty result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch, out = whole.iloc[at : at + BATCH], []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    if text is None:
                        out.append((doc_id, None, 0, None, None, True))
                    else:
                        ids = own.own(text)
                        back = own.decode(ids)
                        out.append((doc_id, np.frombuffer(ids, "<i4"), len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode("utf-8", "replace")), back == text))
                frame = pd.DataFrame(out, columns=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_crc32", "exact"])
                yield frame.astype({"doc_id": "Int64", "ids_crc32": "Int64", "decoded_crc32": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, ids array<int>, n_tokens int, ids_crc32 long, decoded_crc32 long, exact boolean")
