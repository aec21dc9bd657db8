"""Embedding near-dedup (operator 3) by an inverted multi-index.

Independent codebooks on the two halves of the unit vectors form a product grid of cells. Every vector is indexed in its
own cell and visits cells in the order of a multi-sequence traversal: by the squared distance that a vector must have
from it to lie in the cell, summed over the halves (a bound, from the bisectors of the codewords). It stops at a radius
that is calibrated for the target recall on vectors turned to the threshold in random directions; a target of 1 takes
the bound at which no link can be missed. Found pairs are verified by cosine in double precision.

Equal vectors collapse first. Vectors of different length link with nothing, and each length has a grid of its own. A
length of at most ``TOGETHER`` vectors is fitted, indexed, traversed and verified in one task, so that any number of
lengths is one job; a longer one is dealt out by cells. Cells are compared block against block, and a task returns counts of links and a spanning forest, never its pairs. A pair that is found from both sides counts in one
of them. A cell holds about ``CELL`` vectors, and more as the square root of all: so codewords grow with the fourth root
of n, and with them the cells that a vector visits, while comparisons, products of matrices, grow with n**(3/4) a vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components
from .storage import cut

#: Vectors that the codebooks are fitted on, and calibrated on; the first by hash order.
SAMPLE, CALIBRATION = 8192, 1024
#: Vectors in a cell, at least about, and as a multiple of the square root of all.
CELL, CELL_ROOT = 64, 4
#: Vectors of a length that one task takes whole.
TOGETHER = 4096
TARGET_RECALL = 0.999
#: Vectors of a block of the index, of the queries.
INDEX_BLOCK, QUERY_BLOCK = 1024, 4096
#: Pairs that are verified at a time.
SLICE = 1 << 16


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances; each row's are summed alike in whatever batch it comes."""
    return np.stack([np.square(x - c).sum(axis=1) for c in codes], axis=1)


def _fit(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means codewords."""
    rng = np.random.Generator(np.random.PCG64(17))
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (np.square(codes).sum(1) - 2 * x @ codes.T).argmin(axis=1)
        n = np.bincount(own, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, own, x)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    return np.unique(codes, axis=0)


@dataclass
class Grid:
    """Codebooks of the halves, the gaps between codewords, and the squared radius of a traversal."""

    codes: list[np.ndarray]
    gaps: list[np.ndarray]
    radius: float

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        k = self.codes[0].shape[1]
        return [x[:, :k], x[:, k:]]

    def places(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's cell and, by half, the squared distance it must at least go to reach each codeword's region."""
        own, bounds = [], []
        for part, codes, gaps in zip(self.halves(x), self.codes, self.gaps, strict=True):
            d = _distances(part, codes)
            best = d.argmin(axis=1)
            own.append(best)
            bounds.append(np.square(np.maximum(d - d[np.arange(len(d)), best][:, None], 0) / gaps[best]))
        return own[0] * len(self.codes[1]) + own[1], bounds

    def visits(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Multi-sequence traversal: cells by ascending a + b, up to the radius."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        ahead, n = [(a[i[0]] + b[j[0]], 0, 0)], len(self.codes[1])
        while ahead:
            bound, p, q = heapq.heappop(ahead)
            if bound > self.radius:
                return
            yield int(i[p]) * n + int(j[q])
            if q + 1 < len(j):
                heapq.heappush(ahead, (a[i[p]] + b[j[q + 1]], p, q + 1))
            if q == 0 and p + 1 < len(i):
                heapq.heappush(ahead, (a[i[p + 1]] + b[j[0]], p + 1, 0))


def _units(column) -> np.ndarray:
    x = np.stack(list(column)).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, n: int, threshold: float, target: float = TARGET_RECALL) -> Grid:
    """A grid for n vectors from a sample of unit vectors. The radius is the target quantile of the bound to the cell of
    a vector turned to the threshold in a random direction, and never more than the bound that misses nothing."""
    k = max(1, int(np.ceil(np.sqrt(n / max(CELL, CELL_ROOT * np.sqrt(n))))))
    half = x.shape[1] // 2
    codes = [_fit(x[:, :half], k), _fit(x[:, half:], k)]
    gaps = [np.maximum(2 * np.sqrt(_distances(c, c)), 1e-12) for c in codes]
    certain = 2 * (1 - threshold) + 1e-9
    grid = Grid(codes, gaps, certain)
    if target < 1:
        rng = np.random.Generator(np.random.PCG64(23))
        one = np.repeat(x[:CALIBRATION], 8, axis=0)
        aside = rng.standard_normal(one.shape)
        aside -= (aside * one).sum(1, keepdims=True) * one
        norm = np.sqrt(np.square(aside).sum(1, keepdims=True))
        turned = threshold * one + np.sqrt(1 - threshold**2) * aside / np.maximum(norm, 1e-12)
        cell, (a, b) = grid.places(turned)[0], grid.places(one)[1]
        at = np.arange(len(one))
        grid.radius = min(certain, float(np.quantile(a[at, cell // len(codes[1])] + b[at, cell % len(codes[1])], target)))
    return grid


class _Links:
    """Counts of links and the components that they make, of rows 0 to n - 1."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        self.n, self.root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.n, i, self.copies[j])
        np.add.at(self.n, j, self.copies[i])
        while len(i):  # roots only go down; pairs within a component leave
            low, high = np.minimum(self.root[i], self.root[j]), np.maximum(self.root[i], self.root[j])
            np.minimum.at(self.root, high, low)
            while not np.array_equal(self.root, self.root[self.root]):
                self.root = self.root[self.root]
            apart = self.root[i] != self.root[j]
            i, j = i[apart], j[apart]

    def rows(self) -> pd.DataFrame:
        """(src, dst, n): n links of src (dst null), and an edge from each row to its component's root (n 0)."""
        some, hung = np.flatnonzero(self.n), np.flatnonzero(self.root != np.arange(len(self.ids)))
        out = pd.DataFrame({"src": np.concatenate((self.ids[some], self.ids[hung])), "n": np.concatenate((self.n[some], np.zeros(len(hung), np.int64)))})
        out["dst"] = pd.array([None] * len(some) + self.ids[self.root[hung]].tolist(), "Int64")
        return out[["src", "dst", "n"]]


def _pairs(x: np.ndarray, q: np.ndarray, m: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of q, j of m) whose cosine reaches the threshold in double precision, in parts of bounded size."""
    for at in range(0, len(q), 1024):
        i, j = np.nonzero(x[q[at : at + 1024]] @ x[m].T >= threshold - 1e-9)
        for k in range(0, len(i), SLICE):
            a, b = q[at + i[k : k + SLICE]], m[j[k : k + SLICE]]
            exact = (x[a] * x[b]).sum(axis=1) >= threshold
            yield a[exact], b[exact]


def _meet(links: _Links, grid: Grid, x: np.ndarray, cell: np.ndarray, bounds: list[np.ndarray], q: np.ndarray, m: np.ndarray, threshold: float) -> None:
    """Verify visitors q of a cell against members m of it. A pair that meets in both rows' cells counts in one."""
    (a, b), width = bounds, len(grid.codes[1])
    for i, j in _pairs(x, q, m, threshold):
        back = a[j, cell[i] // width] + b[j, cell[i] % width] <= grid.radius  # j visits i's cell too
        keep = (i != j) & (~back | (i < j))
        links.add(i[keep], j[keep])


def _compared(placed: DataFrame, grid, threshold: float) -> DataFrame:
    """(src, dst, n) as of ``_Links`` from rows (task, cell, ib, qb, side, id, v, copies): side 0 has the queries, 1 the index."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, first, where = np.unique(group["id"].to_numpy(), return_index=True, return_inverse=True)
        x, side = _units(group["v"].iloc[first]), group["side"].to_numpy()
        cell, bounds = grid.value.places(x)
        links = _Links(ids, group["copies"].to_numpy()[first])
        for at in group.groupby(["cell", "ib", "qb"], sort=False).indices.values():
            _meet(links, grid.value, x, cell, bounds, where[at[side[at] == 0]], where[at[side[at] == 1]], threshold)
        return links.rows()

    return placed.groupBy("task").applyInPandas(run, "src long, dst long, n long")


def _together(reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """The same of rows (id, v, copies), each length by a grid of its own in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x, links = _units(group["v"]), _Links(group["id"].to_numpy(), group["copies"].to_numpy())
        grid = fit(x, len(x), threshold, target)
        cell, bounds = grid.places(x)
        met = [np.fromiter(grid.visits(p, q), np.int64) for p, q in zip(*bounds, strict=True)]
        visitor, visited = np.repeat(np.arange(len(x)), [len(c) for c in met]), np.concatenate(met)
        order = np.argsort(visited, kind="stable")
        visitor, visited = visitor[order], visited[order]
        for c in np.unique(cell):
            _meet(links, grid, x, cell, bounds, visitor[slice(*np.searchsorted(visited, (c, c + 1)))], np.flatnonzero(cell == c), threshold)
        return links.rows()

    return reps.withColumn("d", F.size("v")).groupBy("d").applyInPandas(run, "src long, dst long, n long")


def _indexed(reps: DataFrame, n: int, threshold: float, target: float) -> DataFrame:
    """The same of n rows (id, v, copies) of one length, by a grid."""
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    grid = reps.sparkSession.sparkContext.broadcast(fit(_units(sample["v"]), n, threshold, target))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, (a, b) = grid.value.places(_units(batch["v"]))
                met = [list(grid.value.visits(p, q)) for p, q in zip(a, b, strict=True)]
                yield pd.DataFrame({"id": batch["id"], "cell": cell, "met": met})

    placed = cut(reps.select("id", "v").mapInPandas(place, "id long, cell long, met array<long>"))
    index, asks = placed.select("id", "cell"), placed.select("id", F.explode("met").alias("cell"))
    blocks = lambda df, c, size: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).alias(c))
    sizes = blocks(index, "ibs", INDEX_BLOCK).join(blocks(asks, "qbs", QUERY_BLOCK), "cell")
    of = lambda df, side: df.join(sizes, "cell").withColumns({"side": F.lit(side), "ib": F.pmod(F.xxhash64("id"), "ibs"), "qb": F.pmod(F.xxhash64("id", F.lit(1)), "qbs")})
    index = of(index, 1).withColumn("qb", F.explode(F.expr("sequence(0L, qbs - 1)")))
    asks = of(asks, 0).withColumn("ib", F.explode(F.expr("sequence(0L, ibs - 1)")))
    both = index.unionByName(asks).join(reps.select("id", "v", "copies"), "id")
    few = max(1, n // 1024)
    both = both.withColumn("task", F.when(F.col("ibs") * F.col("qbs") > 1, F.xxhash64("cell", "ib", "qb")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(few))))
    return _compared(both.drop("ibs", "qbs"), grid, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, target: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding; more columns are ignored).

    Vectors that are null, empty, zero, or have null or non-finite components link with nothing; vectors link with those
    of their own length only. Rows with a null vec_id are left out; a repeated vec_id counts as one more vector of the
    same id. An empty table gives an empty result. Vectors stay in the table's type (float or double) until they are
    compared, in double precision."""
    kind = vectors.schema["embedding"].dataType
    small = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col("embedding") if small else F.col("embedding").cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), good.alias("good"), v.alias("v"))
    name = ["k1", "k2"]
    known = rows.select("vec_id", "good", F.when(F.col("good"), F.col("v")).alias("v")).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(5), "v")})
    reps = cut(known.filter("good").groupBy(*name).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min_by("v", "vec_id").alias("v")))
    lengths = reps.groupBy(F.size("v").alias("d")).count().filter(F.col("count") > TOGETHER).collect()  # at most n / TOGETHER
    few = reps.filter(~F.size("v").isin([r["d"] for r in lengths])) if lengths else reps
    found = _together(few, threshold, target)
    for r in lengths:
        found = found.unionByName(_indexed(reps.filter(F.size("v") == r["d"]), r["count"], threshold, target))
    found = cut(found)
    links = found.filter("dst is null").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("dst is not null").select("src", "dst"))
    of_rep = reps.select(*name, "id", "copies").join(links, "id", "left").join(parts, "id", "left")
    of_rep = of_rep.select(*name, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.lit(True).alias("good"))
    out = known.select("vec_id", "good", *name).join(of_rep, [*name, "good"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
