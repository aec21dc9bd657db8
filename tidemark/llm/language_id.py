"""Language identification (operator 7): multinomial naive Bayes over hashed character n-grams.

Counts of one to three lower-cased code points, hashed to ``BUCKETS``, are summed over all documents that may teach.
The matrix of log-probabilities (buckets x languages) is broadcast. A task makes one sparse matrix (texts x buckets) of
the counts in a batch and multiplies it by that matrix, a bounded number of its entries at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import held_out
from .names import free_name

BITS = 15
BUCKETS = 1 << BITS
SMOOTHING = 0.5
#: Languages of a block of the matrix, which then has at most 64 MB. A model of more has several, each of them a broadcast.
LANGUAGES = 256
#: Cells that a step of the product of a batch has at most.
CELLS = 1 << 21
#: Code points taken at a time from a long text.
CHUNK = 1 << 16
UNKNOWN = "und"
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, in parts."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    for k in range(0, len(at), CHUNK):
        c = at[k : k + CHUNK + 2]
        own = min(CHUNK, len(c))
        one = c * _MIX[0]
        two = one[:-1] * np.uint32(31) + c[1:] * _MIX[1]
        three = two[:-1] * np.uint32(31) + c[2:] * _MIX[2]
        yield np.concatenate([(x[:own] ^ (x[:own] >> np.uint32(15))) * _MIX[0] >> np.uint32(32 - BITS) for x in (one, two, three)])


def sparse(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of n-grams of a batch as rows of a sparse matrix: where each text's entries start (and the last end),
    their buckets, their counts. A text that is null or has no letter has none."""
    starts, columns, counts = [0], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for text in texts:
        if text and any(map(str.isalpha, text)):
            total = sum(np.bincount(b, minlength=BUCKETS) for b in buckets(text))
            columns.append(np.flatnonzero(total))
            counts.append(total[columns[-1]])
            starts.append(starts[-1] + len(columns[-1]))
        else:
            starts.append(starts[-1])
    return np.array(starts), np.concatenate(columns), np.concatenate(counts).astype(float)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    prior: np.ndarray

    def part(self, k: int) -> Model:
        """The k-th block of languages."""
        own = slice(k * LANGUAGES, (k + 1) * LANGUAGES)
        return Model(self.languages[own], self.log_p[:, own], self.prior[own])

    def totals(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (texts x languages) of texts with each language, and which texts have letters."""
        starts, columns, counts = sparse(texts)
        out = np.tile(self.prior, (len(starts) - 1, 1))
        step = max(1, CELLS // max(1, len(self.languages)))
        for at in range(0, len(columns), step):
            own = slice(at, at + step)
            rows = np.searchsorted(starts, np.arange(at, min(at + step, len(columns))), side="right") - 1
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[first]] += np.add.reduceat(counts[own, None] * self.log_p[columns[own]], first, axis=0)
        return out, np.diff(starts) > 0

    def best(self, texts: Iterable[str | None]) -> pd.DataFrame:
        """For each text the likeliest language (of equal ones the first), its log-probability, and the logarithm of the
        sum over all; null without letters."""
        total, known = self.totals(texts)
        top = total.max(axis=1, initial=-np.inf)
        whole = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
        name = np.array(self.languages, object)[total.argmax(axis=1)] if len(total) else np.empty(0, object)
        return pd.DataFrame({"lang": np.where(known, name, None), "top": np.where(known, top, np.nan), "whole": np.where(known, whole, np.nan)})


def train(docs: DataFrame, teaches: Column | None = None) -> Model:
    """Learn from text and lang of the rows for which ``teaches`` (default: not held out) holds; null lang or text
    teaches nothing. Counts are made per task and summed; only languages x buckets of them reach the driver."""
    rows = docs.filter((~held_out() if teaches is None else teaches) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                n[lang] = n.get(lang, 0) + 1
                own = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for b in buckets(text):
                    own += np.bincount(b, minlength=BUCKETS)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(own[at], n[lang])})

    counts = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.toPandas()
    languages = sorted(counts["lang"].unique())
    of = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    bucket, n = counts["bucket"].to_numpy(int), counts["n"].to_numpy(float)
    table, rows_of = np.full((BUCKETS, len(languages)), SMOOTHING), np.ones(len(languages))
    own = bucket >= 0
    table[bucket[own], of[own]] += n[own]
    rows_of[of[~own]] += n[~own]
    return Model(languages, np.log(table / table.sum(axis=0)), np.log(rows_of / rows_of.sum()))


def predict(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """All columns of docs and a struct (lang_pred, score) as ``into`` (with underscores behind it if docs has such a
    column) from the whole text alone: the likeliest language, of equal ones the alphabetically first, and its posterior
    probability; ``und``, 0 if there is no letter or no language. Blocks of more than LANGUAGES languages are scored one
    by one, and the best of their bests is taken, so that their number changes no result."""

    def block(k: int) -> Column:
        spread = docs.sparkSession.sparkContext.broadcast(model.part(k))

        @F.pandas_udf("lang string, top double, whole double")
        def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield spread.value.best(texts)

        return best("text")

    into = free_name(docs, into)
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return docs.withColumn(into, none)
    names = [free_name(docs, f"_block{k}") for k in range(-(-len(model.languages) // LANGUAGES))]
    found = docs.withColumns({name: block(k) for k, name in enumerate(names)})
    top = F.col(names[0])
    for name in names[1:]:
        top = F.when(F.col(name)["top"] > top["top"], F.col(name)).otherwise(top)
    share = reduce(lambda a, b: a + b, (F.exp(F.col(name)["whole"] - top["top"]) for name in names))
    told = F.struct(top["lang"].alias("lang_pred"), (1 / share).alias("score"))
    return found.withColumn(into, F.when(top["lang"].isNull(), none).otherwise(told)).drop(*names)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang; more columns are ignored),
    repeated ones included. A null or letterless text, and any text if nothing teaches, is ``und`` with score 0; an
    empty table gives an empty result."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
