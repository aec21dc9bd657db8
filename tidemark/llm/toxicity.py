"""Toxicity (operator 10): class-conditional Kneser-Ney models of words.

A model each of toxic and of ordinary documents has Kneser-Ney counts: n_c(w) is the number of different contexts that a
word w has in class c, and a context is a document, so that neither a word's repetition nor an exact copy of a document
counts twice. Each model is discounted by D and backs off to counts that both share, k(w), in how many classes w is:

    P_c(w) = max(n_c(w) - D, 0) / N_c + l_c P(w)          P(w) = max(k(w) - D, 0) / K + l / SLOTS

with N_c and K the sums of n_c and k, and l_c and l the mass that discounting frees. What is rare in both classes has the
ratio l_t / l_o of the freed masses, so it says little. As toxic documents are ordinary language with some toxic
expressions in it, their likelihood is that of a mixture, and the log-likelihood ratio of a word is

    r(w) = log((1 - MIXED) + MIXED P_t(w) / P_o(w)).

A document's two features are length-normalised: the mean of r over all its words and the greatest mean over a stretch of
``STRETCH`` words. A logistic curve, which rises with both, gives the score; it is fitted on a bounded sample of the documents
that teach, each with its own counts taken out (leave one out).

Words are hashed to ``SLOTS``; all that share a slot are one expression, and no entry is ever left out. So the counts of
all labelled documents are one table of fixed size at any size of the corpus: tasks sum it up, and 8 MB are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .folds import held_out
from .names import free_name

BITS = 21
SLOTS = 1 << BITS
#: Slots whose ratios are computed at a time, so that the driver holds few numbers beside the counts.
CHUNK = 1 << 16
DISCOUNT = 0.9
#: Share of a toxic document's words that come from the toxic model.
MIXED = 0.01
#: Words in a stretch: several times those between two toxic ones.
STRETCH = 256
#: Documents of each class that fit the curve (as expected; they are drawn by hash).
CURVE = 2000
#: Curve before any document is seen: intercept, and slopes for features in nats per 200 words; what it weighs.
PRIOR, WEIGHT, PER = np.array([-4.0, 1.5, 1.5]), 0.5, 200
#: A count is four bytes; a word in more documents of a class counts as in so many, which moves no ratio that matters.
MOST = 2**31 - 1
#: Labelled documents whose ids are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def slots(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The slots of each text's words (of letters), in order."""
    return ((x >> np.uint64(64 - BITS)).astype(np.int64) for x in T.words(texts, letters=True))


@dataclass
class Counts:
    """n_o and n_t by slot."""

    n: np.ndarray

    def __post_init__(self) -> None:
        seen = self.n > 0
        self.total = self.n.sum(axis=1, dtype=float)
        self.freed = [DISCOUNT * float(seen[c].sum()) / max(self.total[c], 1.0) for c in (0, 1)]
        self.kinds = float(seen.sum())
        self.base = DISCOUNT * float((seen[0] | seen[1]).sum()) / max(self.kinds, 1.0) / SLOTS

    def ratios(self) -> np.ndarray:
        """r by slot."""
        return np.concatenate([self.ratio(self.n[:, at : at + CHUNK]).astype(np.float32) for at in range(0, SLOTS, CHUNK)])

    def ratio(self, n: np.ndarray) -> np.ndarray:
        """r of words with counts n (2 x words)."""
        if not self.total.all():
            return np.zeros(n.shape[1])
        shared = np.maximum((n > 0).sum(axis=0) - DISCOUNT, 0) / self.kinds + self.base
        o, t = (np.maximum(n[c] - DISCOUNT, 0) / self.total[c] + self.freed[c] * shared for c in (0, 1))
        return np.log(1 - MIXED + MIXED * t / o)


def features(r: np.ndarray) -> tuple[float, float]:
    """The mean of r over a text and its greatest mean over STRETCH words; 0 without words."""
    if not len(r):
        return 0.0, 0.0
    if len(r) <= STRETCH:
        return float(r.mean()), float(r.mean())
    upto = np.concatenate(([0.0], np.cumsum(r)))
    return float(r.mean()), float((upto[STRETCH:] - upto[:-STRETCH]).max() / STRETCH)


def curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of rows of features."""
    return 1 / (1 + np.exp(-np.clip(weights[0] + x.reshape(-1, 2) * PER @ weights[1:], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the curve by Newton's method: both classes weigh the same, slopes are not negative, and few documents
    move it little from PRIOR."""
    w = PRIOR.copy()
    if not (y > 0).any() or not (y < 1).any():
        return w
    a = np.column_stack((np.ones(len(x)), x * PER))
    mass = np.where(y > 0, (y < 1).sum() / (y > 0).sum(), 1.0)
    for _ in range(100):
        p = curve(x, w)
        push = a.T @ (mass * (y - p)) - WEIGHT * (w - PRIOR)
        step = np.linalg.solve((a * (mass * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + WEIGHT * np.eye(3), push)
        w = w + step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        w[1:] = np.maximum(w[1:], 0)
    return w


@dataclass
class Model:
    """r by slot, and the curve."""

    ratio: np.ndarray
    weights: np.ndarray

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        return curve(np.array([features(self.ratio[s].astype(float)) for s in slots(texts)]).reshape(-1, 2), self.weights)


def _taught(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fits) of the documents that teach, exact copies once; ``fits`` marks a bounded sample by hash."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    near = F.broadcast if n[0] + n[1] <= BROADCAST_ROWS else lambda df: df
    named = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(5), "text").alias("k2"))
    single = named.join(near(known), "doc_id").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    single = single.select("doc_id", "toxic", (draw < F.when(F.col("toxic") == 1, CURVE / max(n[1], 1)).otherwise(CURVE / max(n[0], 1))).alias("fits"))
    return docs.select("doc_id", "text").join(near(single), "doc_id").select("text", "toxic", "fits")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from whole texts of all documents that labels (doc_id, toxic: 0 or 1) marks and that are not held out.
    Null labels or texts teach nothing; a document or a text that is marked twice counts as toxic if it is so once. If
    nothing of one class teaches, every score is the same."""
    taught = _taught(docs, labels)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            for s, toxic in zip(slots(batch["text"]), batch["toxic"], strict=True):
                n[toxic, np.unique(s)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pd.DataFrame({"slot": at.astype(np.int32), "o": n[0, at], "t": n[1, at]})

    sums = taught.mapInPandas(count, "slot int, o int, t int").groupBy("slot").agg(*(F.least(F.sum(c), F.lit(MOST)).cast("int").alias(c) for c in "ot")).toArrow()
    n = np.zeros((2, SLOTS), np.int32)
    for batch in sums.to_batches():
        slot, o, t = (c.to_numpy() for c in batch.columns)
        n[0, slot], n[1, slot] = o, t
    del sums
    counts = Counts(n)
    spread = docs.sparkSession.sparkContext.broadcast(counts)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, toxic in zip(slots(batch["text"]), batch["toxic"], strict=True):
                own = spread.value.n[:, s]
                own[toxic] -= 1
                out.append((*features(spread.value.ratio(own)), int(toxic)))
            yield pd.DataFrame(out, columns=["whole", "stretch", "toxic"])

    met = taught.filter("fits").mapInPandas(left_out, "whole double, stretch double, toxic int").toPandas().sort_values(["toxic", "whole", "stretch"])
    spread.unpersist()
    return Model(counts.ratios(), fit(met[["whole", "stretch"]].to_numpy(), met["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """All columns of docs and the score (0 to 1) as ``into`` (with underscores behind it if docs has such a column),
    from the whole text alone; a null text counts as empty. Repeated rows are scored alike; an empty table gives an
    empty result."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(spread.value.score(texts))

    return docs.withColumn(free_name(docs, into), scores("text"))


def classify(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text; more columns are ignored), empty and
    repeated ones included: predicted is 1 if the score reaches ``limit``. An empty table gives an empty result."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
