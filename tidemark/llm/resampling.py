"""Target-distribution importance resampling (operator 12): documents are drawn as if from a target corpus.

Features are all runs of 1 to ``order`` consecutive words. A 256-byte table lower-cases and blanks separators in UTF-8,
``bytes.split`` gives the words, a run's crc32 goes on from that of the run without its last word, and Counters reduce
in tasks. What reaches the driver is one count a bucket.

Drawing needs ranks over all documents: rows are dealt by ranges of (score, doc_id), written with the number of their
range, and ranked within it; the ranges' sizes, one number each, give every range its first rank.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .words import words

#: Distinct runs of words of which a task remembers the bucket or gain.
MEMO = 300_000
#: Rows of a range, about, when ranks are given.
RANGE = 1_000_000


def features(own: list[bytes], order: int) -> Counter[int]:
    """crc32 of each run of 1 to order words, joined by one blank, and how often it occurs."""
    seeds = [zlib.crc32(w) for w in own]
    out = Counter(seeds)
    for k in range(1, order):
        seeds = [zlib.crc32(w, zlib.crc32(b" ", seed)) for seed, w in zip(seeds, own[k:])]  # noqa: B905  the last runs end
        out.update(seeds)
    return out


def single(own: Counter[bytes]) -> Counter[int]:
    """The same of single words that are counted already."""
    out: Counter[int] = Counter()
    for word, n in own.items():
        out[zlib.crc32(word)] += n
    return out


def bucket_counts(docs: DataFrame, buckets: int, order: int = 1) -> np.ndarray:
    """How many features of all texts of docs fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter[int] = Counter()
            if order == 1:
                own: Counter[bytes] = Counter()
                for raw in batch.column(0).to_pylist():
                    own.update(words(raw))
                    if len(own) > MEMO:
                        seen.update(single(own))
                        own.clear()
                seen.update(single(own))
            else:
                for raw in batch.column(0).to_pylist():
                    seen.update(features(words(raw), order))
            if seen:
                np.add.at(total, np.fromiter(seen.keys(), np.int64, len(seen)) % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of B buckets, in doubles."""
    size = len(corpus)
    whole, of = float(int(corpus.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * of))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of docs; a document without words has weight 0."""
    spread = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = spread.value.tolist(), len(spread.value)
        memo: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for raw in batch.column(1).to_pylist():
                own, weight = words(raw), 0
                if order == 1:
                    for w, n in Counter(own).items():
                        one = memo.get(w)
                        if one is None:
                            if len(memo) >= MEMO:
                                memo.clear()
                            one = memo[w] = table[zlib.crc32(w) % size]
                        weight += one * n
                    n_features.append(len(own))
                else:
                    found = features(own, order)
                    weight = sum(table[f % size] * n for f, n in found.items())
                    n_features.append(found.total())
                n_words.append(len(own))
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weights))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)): u comes from the first 8 hex digits of sha256(``seed:doc_id``). A null id is as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """rows (doc_id, score, and more), with a column rank: 1, 2, ... by falling score, equal ones by rising doc_id (null
    last), of the floor(n * share / 100) first; null for the others. Repeats of a row get neighbouring ranks."""
    spark, n = rows.sparkSession, rows.count()
    drawn = n * share // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = cut(rows.repartitionByRange(max(-(-n // RANGE), spark.sparkContext.defaultParallelism), *order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    first = [(k, before) for (k, _), before in zip(sizes, accumulate((size for _, size in sizes), initial=0))]  # noqa: B905
    starts = spark.createDataFrame(first, "_range int, _first long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    at = dealt.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_first") + place)
    return at.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_range", "_first")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, order: int = 1, seed: int = 2024, least_words: int = 20, share: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs (doc_id, text; more columns are ignored): weight
    sums the gains of the document's features towards the texts of target (column text), score adds noise that the id
    and seed decide, and of the documents of least_words words or more the share (in a hundred) of highest scores is
    drawn; rank is null for the rest. A null or empty text has no feature and weight 0; a null doc_id is hashed as
    empty and comes last among equals; rows that repeat are all returned. Empty tables: an empty docs gives an empty
    result, an empty target leaves all t at 0."""
    docs = docs.select("doc_id", "text")
    gain = gains(bucket_counts(docs, buckets, order), bucket_counts(target, buckets, order))
    scored = cut(weigh(docs, gain, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    named = ["doc_id", "n_features", "weight", "score"]
    short = scored.filter(F.col("n_words") < least_words).select(*named, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.filter(F.col("n_words") >= least_words).select(*named), share).select(*named, "rank").unionByName(short)


#: The same in DuckDB; crc32 byte by byte, over each distinct word once.
ORACLE_SQL = r"""
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dn AS (SELECT doc_id, word, count(*) AS n FROM d GROUP BY ALL),
bn AS (SELECT word, count(*) AS n FROM b GROUP BY ALL),
w AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(word))) + 1, 2), lambda k: ('0x' || substr(hex(encode(word)), k, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) % 10000 AS bucket
  FROM (SELECT word FROM dn UNION SELECT word FROM bn), steps),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dn JOIN w USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bn JOIN w USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dn JOIN w USING (word) JOIN g USING (bucket) GROUP BY doc_id),
c AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM c LEFT JOIN r USING (doc_id)
"""
