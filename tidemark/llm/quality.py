"""Quality classifier (operator 8) by co-training.

Two views of a document have a logistic regression each: its text (hashed byte pairs and shape) and its page's metadata
(hashed source and language, length). Over rounds, each view scores all unlabelled documents and labels those it is
surest of, by quantiles over all of them, for the other to learn from; Spark does both, and a bounded sample of what is
labelled by then fits the weights. Both are then calibrated on labelled documents that neither has seen, and a document's score
combines the calibrated log-odds with weights fitted on those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import held_out
from .storage import cut, forget

PAIRS, METADATA = 512, 64
SHAPE = 8
#: Documents that fit a view's weights: of those with a label, of those that the other view has labelled; the first of
#: each by hash order.
LABELLED, TOLD = 4000, 2000
ROUNDS = 4
#: Share of the documents that a view has not labelled yet that it labels in a round.
CONFIDENT = 0.02


def text_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, then shares of kinds of bytes, of repeated lines, and lengths."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(PAIRS + SHAPE, np.float32)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    if len(b) > 1:
        pair = ((b[:-1].astype(np.uint32) * 257 + b[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(23)
        out[:PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(pair))
    kinds = np.bincount(_KIND[b], minlength=5)[1:] / len(b)
    lines = [x for x in text.split("\n") if x.strip()]
    out[PAIRS:] = [*kinds, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(b) / max(1, len(lines))) / 10, np.log1p(len(b)) / 10, 1.0]
    return out


_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[48:58], _KIND[[9, 10, 13, 32]] = 1, 2, 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def metadata_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed language and source, and the length by powers of two; nulls are values of their own."""
    out = np.zeros(METADATA + 24, np.float32)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode("utf-8", "replace")) % METADATA] = 1
    known = n_chars is not None and n_chars == n_chars
    out[METADATA + (min(22, int(np.log2(max(1.0, float(n_chars))))) if known else 23)] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression with a quadratic penalty (not on the intercept, the last weight) by Newton's method."""
    x = np.column_stack((x, np.ones(len(x)))).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], pull)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = _curve(x @ w)
        w += np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Model:
    text: np.ndarray
    metadata: np.ndarray
    text_line: np.ndarray  # calibration: slope, intercept
    metadata_line: np.ndarray
    mixture: np.ndarray  # weights of the calibrated log-odds, intercept

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        a = _odds(_odds(text, self.text)[:, None], self.text_line)
        b = _odds(_odds(metadata, self.metadata)[:, None], self.metadata_line)
        return _curve(_odds(np.column_stack((a, b)), self.mixture))


def _calibrated(weights: list[np.ndarray], views: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of both views' weights, calibrated on labelled documents that they have not seen."""
    odds = [_odds(v, w) for v, w in zip(views, weights, strict=True)]
    if len(np.unique(y)) < 2:
        return Model(*weights, np.array([1.0, 0]), np.array([1.0, 0]), np.array([0.5, 0.5, 0]))
    lines = [_fit(o[:, None], y) for o in odds]
    both = np.column_stack([_odds(o[:, None], line) for o, line in zip(odds, lines, strict=True)])
    return Model(*weights, *lines, _fit(both, y))


def _views(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n_chars = batch["n_chars"].astype(object).where(batch["n_chars"].notna(), None)
    return np.stack([text_view(t) for t in batch["text"]]), np.stack([metadata_view(*x) for x in zip(batch["lang"], batch["source"], n_chars, strict=True)])


def _collected(docs: DataFrame, chosen: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Both views, y and doc_id of the documents of a bounded table (doc_id, y), in order."""

    def view(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = _views(batch)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"].astype(int), "a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]})

    at = docs.join(F.broadcast(chosen), "doc_id").mapInPandas(view, "doc_id long, y int, a binary, b binary").toPandas()
    at = at.sort_values(["doc_id", "a", "b"], kind="stable")
    views = [np.frombuffer(b"".join(at[c]), np.float32).reshape(len(at), -1) if len(at) else np.zeros((0, n), np.float32) for c, n in (("a", PAIRS + SHAPE), ("b", METADATA + 24))]
    return views, at["y"].to_numpy(), at["doc_id"].to_numpy()


def _pool(docs: DataFrame, known: DataFrame, rounds: list[tuple[list[np.ndarray], list[list[float]]]]) -> DataFrame:
    """(doc_id, odds0, odds1, told0, told1) of every row without label: the odds of both views by the weights of the last
    of ``rounds``, and what each view has called it in the rounds before, whose weights and limits those are (null: not
    yet). Equal odds are told apart by hash."""
    spread = docs.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = {"doc_id": batch["doc_id"]}
                for own, view in enumerate(_views(batch)):
                    told = np.full(len(batch), -1)
                    for weights, limits in spread.value:
                        odds = _odds(view, weights[own]) + batch["apart"].to_numpy()
                        if limits:
                            low, high = limits[own]
                            told = np.where(told >= 0, told, np.where(odds >= high, 1, np.where(odds <= low, 0, -1)))
                    out[f"odds{own}"], out[f"told{own}"] = odds, told
                yield pd.DataFrame(out)

    apart = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.lit(1e-6)
    scored = docs.withColumn("apart", apart).mapInPandas(run, "doc_id long, odds0 double, odds1 double, told0 int, told1 int")
    return cut(scored.join(known.select("doc_id"), "doc_id", "left_anti"), keep=False)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, told: int = TOLD) -> Model | None:
    """Learn from a bounded sample of documents that labels (doc_id, quality) marks and that are not held out, and, by
    rounds of co-training, from all documents without label, of which ``told`` that the other view is sure of fit a
    view's weights; null labels count as none. None if the labelled ones are not of both classes."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    order = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")
    ids = docs.select("doc_id").distinct().join(known, "doc_id")
    views, y, doc_ids = _collected(docs, order(ids.filter(~held_out()), labelled))
    calibrates = np.array([zlib.crc32(f"c{i}".encode()) % 4 == 0 for i in doc_ids], bool)
    if len(np.unique(y[~calibrates])) < 2:
        return None
    seen, y_seen = [v[~calibrates] for v in views], y[~calibrates]
    share, rounds = float(y_seen.mean()), []
    weights = [_fit(v, y_seen) for v in seen]
    for _ in range(ROUNDS):
        pool = _pool(docs, known, [*rounds, (weights, [])])
        at = [CONFIDENT * (1 - share), 1 - CONFIDENT * share]
        free = [F.when(F.col(f"told{own}") < 0, F.col(f"odds{own}")) for own in range(2)]
        row = pool.agg(*(f for own in range(2) for f in (F.count(free[own]), F.percentile_approx(free[own], at, 100_000)))).first()
        if min(row[0], row[2]) * CONFIDENT < 1:
            forget(pool)
            break
        limits = [row[1], row[3]]
        rounds.append((weights, limits))
        weights = []
        for own, other in ((0, 1), (1, 0)):  # a view learns from what the other has told
            low, high = limits[other]
            odds = F.col(f"odds{other}")
            called = F.when(F.col(f"told{other}") >= 0, F.col(f"told{other}")).when(odds >= high, 1).when(odds <= low, 0)
            chosen = order(pool.select("doc_id", called.alias("y")).filter("y is not null"), told).groupBy("doc_id").agg(F.min("y").alias("y"))
            extra, y_extra, _ = _collected(docs, chosen)
            weights.append(_fit(np.concatenate((seen[own], extra[own])), np.concatenate((y_seen, y_extra))))
        forget(pool)
    return _calibrated(weights, [v[calibrates] for v in views], y[calibrates])


def classify(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, lang, source, n_chars; more columns are
    ignored): score is the probability that the quality label is 1, predicted is 1 from ``limit`` on. Nulls in any column
    are values; repeated rows are all scored; if labels of both classes are missing every score is 0.5; an empty table
    gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = model.value.score(*_views(batch)) if model.value else np.full(len(batch), 0.5)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "held_out": batch["held_out"]})

    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars", held_out().alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, score double, held_out boolean").withColumn("predicted", (F.col("score") >= limit).cast("int"))
