"""Token counts (operator 11): pieces are counted once for each distinct pre-token and joined to the frequencies of
pre-tokens in each document; no document's ids are made.

A pre-token begins at a blank (or the text's start) or at a line's end, where no piece runs across; a longer one is cut
further between characters that are neighbours in no piece. So what merging makes of a text is what it makes of its
pre-tokens, one by one. Keys: ``word`` stands for a blank and word, ``\\nword`` for a line's end and word, `` rest`` for
a part that has been cut off.

The corpus's frequencies of pre-tokens are counted first, and the library counts the pieces of each. Pre-tokens that
make up 1 / SHARE or more of all occurrences, of which there can be at most SHARE, are broadcast as hashes; a hash that
any other pre-token of the corpus shares is left out, so a hit is exact. All others are joined by key: none of them is
frequent, so no key is hot.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

SPACE = "▁"
#: At most so many pre-tokens are broadcast, 12 bytes each.
SHARE = 1 << 23
#: Code points from which a pre-token is cut further; bytes above which its digest stands for it in joins.
LONG, KEY = 48, 64
#: Distinct pre-tokens, and code points of long ones, that a task holds at a time.
HELD, HELD_LONG = 250_000, 1 << 24
#: Documents that a task hands over at a time.
BATCH = 2_000


class PreTokens:
    """Cuts texts where no piece of a model runs across. The model must have byte fallback, a dummy prefix and no other
    normalisation, and no piece with a blank behind another character or with a line's end."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec, kinds = proto.normalizer_spec, proto.trainer_spec
        texts = [p.piece for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        if not plain or not kinds.byte_fallback or kinds.treat_whitespace_as_suffix or any(SPACE in t.lstrip(SPACE) or "\n" in t for t in texts):
            raise ValueError(f"{path}: only models with byte fallback, a dummy prefix and no normalisation are supported")
        self.near = {t[k : k + 2] for t in texts for k in range(len(t) - 1)}
        spec.add_dummy_prefix = False  # a key tells whether a blank is in front
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.parts = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*").findall

    def counts(self, text: str) -> dict[str, int]:
        """How often each key occurs in a text."""
        if not text:
            return {}
        if text[0] == " " or "  " in text or SPACE in text:
            parts = self.parts(SPACE + text.replace(" ", SPACE))
            found = Counter([p[1:] if p[0] == SPACE else p for p in parts])
        else:
            found = Counter(text.split(" "))
            for word in [w for w in found if "\n" in w]:
                n, (first, *rest) = found.pop(word), word.split("\n")
                for part in (first, *["\n" + r for r in rest]):
                    found[part] += n
        for word in [w for w in found if len(w) > LONG]:
            n = found.pop(word)
            for part in self.cut(word):
                found[part] += n
        return found

    def cut(self, word: str) -> Iterator[str]:
        """A key in parts of LONG code points or a few more, as long as there is a place to cut at."""
        begin, mark = 0, ""
        while begin < len(word):
            end = begin + LONG
            while end < len(word) and word[end - 1 : end + 1] in self.near:
                end += 1
            yield mark + word[begin:end]
            begin, mark = end, " "

    def pieces(self, keys: list[str]) -> list[int]:
        """How many pieces the library makes of each key."""
        texts = [k[1:] if k[:1] == " " else k if k[:1] == "\n" else SPACE + k for k in keys]
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@functools.cache
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def join_key(key: Column) -> Column:
    return F.when(F.octet_length(key) > KEY, F.concat(F.lit("  "), F.sha2(key, 256))).otherwise(key)


def _join_key(key: str) -> str:
    raw = key.encode()
    return key if len(raw) <= KEY else "  " + hashlib.sha256(raw).hexdigest()


def vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """(key, hash, n_pieces, n) for each distinct pre-token of docs: its join key, hash, pieces, and how often it
    occurs. Tasks count what they have and hand it on whenever they hold HELD pre-tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, long = pre_tokens(model), Counter(), 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pre_token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found = own.counts(text)
                    held.update(found)
                    if len(text) > 4 * LONG * len(found):  # long pre-tokens
                        long += len(text)
                    if len(held) >= HELD or long >= HELD_LONG:
                        yield give()
                        held, long = Counter(), 0
        yield give()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pre_tokens(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.pieces(batch.column(0).to_pylist()), pa.int64())], [*batch.schema.names, "n_pieces"])

    seen = docs.select("text").mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    counted = seen.mapInArrow(pieces, "pre_token string, n long, n_pieces long")
    return cut(counted.select(join_key(F.col("pre_token")).alias("key"), F.xxhash64("pre_token").alias("hash"), "n_pieces", "n"))


class Frequent:
    """Pieces of pre-tokens by the hash of their keys: sorted hashes, and the pieces of each (0: ask the join)."""

    def __init__(self, hashes: np.ndarray, pieces: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.pieces = hashes[order], pieces.astype(np.uint32)[order]
        twice = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        self.pieces[twice] = self.pieces[twice + 1] = 0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.pieces[at], 0)

    def strike(self, hashes: np.ndarray) -> None:
        self.pieces[np.isin(self.hashes, hashes)] = 0


def frequent(words: DataFrame) -> tuple[Broadcast[Frequent], DataFrame]:
    """The pre-tokens that make up 1 / SHARE or more of all occurrences, broadcast, and the rows of the others."""
    total = words.agg(F.sum("n")).first()[0] or 0
    least = -(-total // SHARE)
    top = words.filter(F.col("n") >= least).select("hash", F.col("n_pieces").cast("int")).toPandas()
    table, rare = Frequent(top["hash"].to_numpy(np.int64), top["n_pieces"].to_numpy(np.int64)), words.filter(F.col("n") < least)
    spread = words.sparkSession.sparkContext.broadcast(table)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(hashes[spread.value.of(hashes) > 0])], ["hash"])

    # hashes of others that are in the table: about none
    if len(clash := rare.select("hash").mapInArrow(shared, "hash long").toPandas()):
        table.strike(clash["hash"].to_numpy(np.int64))
        spread = words.sparkSession.sparkContext.broadcast(table)
    if len(struck := np.unique(table.hashes[table.pieces == 0])):  # frequent ones that share a hash
        told = F.broadcast(words.sparkSession.createDataFrame([(int(h),) for h in struck], "hash long"))
        rare = rare.unionByName(words.filter(F.col("n") >= least).join(told, "hash", "left_semi").select(*words.columns))
    return spread, rare.select("key", "n_pieces")


def _tally(model: str, spread: Broadcast[Frequent]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document a row of what the table knows (n; n_bytes set), and one for each pre-token it does not (n: how
    often; key)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, known = pre_tokens(model), spread.value, {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch, out = whole.slice(at, BATCH), ([], [], [], [], [])
                raws = [x or b"" for x in batch.column(1).to_pylist()]
                counts = [own.counts(raw.decode("utf-8", "replace")) for raw in raws]
                if len(known) > 2 * HELD:
                    known.clear()
                fresh = list({k for found in counts for k in found if k not in known})
                hashes = np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in fresh], np.uint64).view(np.int64)
                known.update(zip(fresh, table.of(hashes).tolist(), strict=True))
                for doc_id, raw, found in zip(batch.column(0).to_pylist(), raws, counts, strict=True):
                    mark = int(np.uint64(xxhash.xxh64_intdigest(raw, 7)).view(np.int64))
                    n = 0
                    for key, times in found.items():
                        if one := known[key]:
                            n += one * times
                        else:
                            for column, value in zip(out, (doc_id, mark, _join_key(key), times, None), strict=True):
                                column.append(value)
                    for column, value in zip(out, (doc_id, mark, f"  {doc_id} {mark}", n, len(raw)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def count(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text; more columns are ignored): tokens as
    the library gives them for the whole text, without begin, end or added special tokens; over_limit: n_tokens > limit.
    A null or empty text has 0 of all. Repeated rows are all returned, and rows that share a doc_id, or have none, are
    told apart by a 64-bit hash of their texts. An empty table gives an empty result.

    Documents' own rows carry a key of their own through the join, so they spread."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spread, rare = frequent(vocabulary(docs, model))
    rows = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_tally(model, spread), "doc_id long, mark long, key string, n long, n_bytes long")
    told = rows.join(rare, "key", "left").select("doc_id", "mark", "n_bytes", (F.col("n") * F.when(F.col("n_bytes").isNull(), F.col("n_pieces")).otherwise(1)).alias("n"))
    by = told.groupBy("doc_id", "mark").agg(F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("copies"), F.sum("n").alias("n"))
    each = by.withColumn("n_tokens", F.expr("n div copies")).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
