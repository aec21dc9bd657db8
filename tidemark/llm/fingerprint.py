"""Document fingerprints (operator 6): threshold-scaled sketches of word shingles, in DataFrame functions only.

A fingerprint keeps every hash of a text's distinct five-word shingles below a fixed fraction of the hash range, so its
size follows the text's, fingerprints of sets of shingles merge to that of their union, and containment can be estimated
between documents of very different length. A text that has words but no hash below the threshold keeps its smallest one,
which a merge drops as soon as there is one below; its containment is 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: md5 hex strings below this are kept: an eighth of the range.
THRESHOLD = "2"
#: Hex digits of a hash that a fingerprint keeps.
DIGITS = 16
#: Rows in a stretch of the id order, about; the number of stretches stays below STRETCHES.
STRETCH, STRETCHES = 2048, 65536
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sorted array of kept hashes of column ``text`` as column ``name``."""
    w, h = f"_{name}_words", f"_{name}_hashes"
    n = F.size(w)
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.md5(F.concat_ws(" ", F.slice(F.col(w), i, SHINGLE)).cast("binary")))
    kept = F.filter(h, lambda x: x < THRESHOLD)
    short = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.substring(x, 1, DIGITS))))
    df = df.withColumn(w, words(F.col(text))).withColumn(h, F.when(n > 0, hashed).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(name, kept)
    return df.withColumn(name, short(F.when((F.size(name) > 0) | (F.size(h) == 0), F.col(name)).otherwise(F.array(F.array_min(h))))).drop(w, h)


def packed(sketch: Column) -> Column:
    """A sketch as bytes, a third of its size as an array; for shuffles."""
    return F.unhex(F.array_join(sketch, ""))


def unpacked(raw: Column) -> Column:
    """The sketch that ``packed`` made bytes of; null: empty."""
    each = DIGITS // 2
    places = F.sequence(F.lit(0), (F.length(raw) / each).cast("int") - 1)
    hashes = F.transform(places, lambda i: F.lower(F.hex(F.substring(raw, i * each + 1, F.lit(each)))))
    return F.when(F.length(raw) > 0, hashes).otherwise(F.array().cast("array<string>"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sets of shingles."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < THRESHOLD)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger holds; two empty sketches: 1, one empty: 0."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).otherwise(0.0)


def _rank(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by bisection."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*map(F.lit, bounds)), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = lambda acc, step: (acc + step <= len(bounds)) & (F.try_element_at(table, acc + step) <= value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, step: F.when(at(acc, step), acc + step).otherwise(acc))


def _with_next(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with ``sketch``, packed, and ``next``, a struct of the row that follows by descending doc_id; after the last comes the
    first. The ids are cut at their quantiles into stretches of about STRETCH rows, each with a copy of the row that heads
    the stretch below, so that no task sees more than a stretch, however the ids lie; only rows that repeat one id stay
    together. The copies are found by at most STRETCHES broadcast ids, and before any sketch is made. Rows with a null id
    are spread by their texts."""
    own = df.columns
    n = df.agg(F.count("doc_id")).first()[0]
    parts = max(1, min(STRETCHES, n // STRETCH))
    bounds = sorted(set(df.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0])) if parts > 1 else []
    apart = -1 - F.pmod(F.xxhash64("text"), F.lit(parts))
    placed = df.withColumn("stretch", F.when(F.col("doc_id").isNull(), apart).otherwise(_rank(F.col("doc_id"), bounds).cast("long"))).withColumn("copy", F.lit(0))
    heads = placed.filter("doc_id is not null").groupBy("stretch").agg(F.max("doc_id").alias("head"))
    down = Window.orderBy(F.desc("stretch"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("stretch").over(down), F.last("stretch").over(whole)).alias("above"))
    copies = placed.join(F.broadcast(heads), placed["doc_id"] == heads["head"]).select(*own, F.col("above").alias("stretch"), F.lit(1).alias("copy"))
    order = Window.partitionBy("stretch").orderBy("copy", F.desc("doc_id"), "text")
    both = with_sketch(placed.unionByName(copies), "text", "sketch").withColumn("sketch", packed(F.col("sketch")))
    return both.withColumn("next", F.when(F.col("doc_id").isNotNull(), F.lead(F.struct(*own, "sketch")).over(order))).filter("copy = 0").drop("stretch", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint (``sketch``, an array), that of the row that follows by descending doc_id (``next``, a
    struct with text and sketch), and of an edit of the text (``edited``, ``edited_sketch``): its last third, rounded
    down, replaced by as many code points, or all, of the next text's start.

    docs needs doc_id and text; more columns are ignored. A null text is empty; an empty one has an empty sketch. Rows
    that repeat a doc_id follow each other by text. Rows with a null doc_id have no place in the order: their next is
    null and their edit appends nothing. An empty table gives an empty result."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = _with_next(base).withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumns({"sketch": unpacked(F.col("sketch")), "next": F.col("next").withField("sketch", unpacked(F.col("next.sketch")))})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.coalesce(F.substring(F.col("next.text"), F.lit(1), third), F.lit("")))
    return with_sketch(out.withColumn("edited", edited), "edited", "edited_sketch")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); a fingerprint is its
    sketch's hashes of 16 hex digits in order, one after the other."""
    text = lambda c: F.array_join(c, "")
    return fingerprints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text("sketch").alias("fingerprint"),
        text("edited_sketch").alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.when(F.col("next").isNotNull(), containment(F.col("sketch"), F.col("next.sketch"))).alias("near_next"),
    )


_HASHES = """list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"""
ORACLE_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
nexts AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text), first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next_text FROM base),
edits AS (SELECT *, left(text, CAST(n_chars - n_chars // 3 AS BIGINT)) || left(next_text, CAST(n_chars // 3 AS BIGINT)) AS edited FROM nexts),
words AS (SELECT *, {_HASHES.format(t="text")} AS w1, {_HASHES.format(t="edited")} AS w2, {_HASHES.format(t="next_text")} AS w3 FROM edits),
hashes AS (SELECT *, {", ".join(f"CASE WHEN len(w{k}) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w{k}) - 3, 2)), lambda i: md5(array_to_string(list_slice(w{k}, i, i + 4), ' '))) END AS h{k}" for k in (1, 2, 3))} FROM words),
kept AS (SELECT *, {", ".join(f"list_sort(list_distinct(list_transform(CASE WHEN len(h{k}) > 0 AND len(list_filter(h{k}, lambda x: x < '2')) = 0 THEN [list_min(h{k})] ELSE list_filter(h{k}, lambda x: x < '2') END, lambda x: left(x, 16)))) AS s{k}" for k in (1, 2, 3))} FROM hashes)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(s1, ''), '') AS fingerprint, coalesce(array_to_string(s2, ''), '') AS edited_fingerprint,
  {", ".join(f"CASE WHEN least(len(s1), len(s{k})) > 0 THEN len(list_intersect(s1, s{k})) / least(len(s1), len(s{k})) WHEN greatest(len(s1), len(s{k})) = 0 THEN 1.0 ELSE 0.0 END AS {name}" for k, name in ((2, "near_edited"), (3, "near_next")))}
FROM kept
"""
