"""MinHash near-dedup (operator 4) with SetSketch registers.

A document's set holds its distinct five-word shingles. Its sketch has ``REGISTERS`` SetSketch registers: the minimum
of exponentially distributed hashes, truncated to exponentially spaced levels of base ``BASE`` (Ertl, "SetSketch:
Filling the Gap between MinHash and HyperLogLog", 2021). Sketches merge by maximum. Equal register bands put documents
into buckets; a pair's similarity is estimated by the joint likelihood of all registers given both set sizes, and what
may reach the threshold is verified on the full sets.

Links must not be lost and a bucket's pairs must not be listed, as one group may hold a third of all rows. Therefore:
1. equal sets collapse into one representative (partial aggregation first);
2. each member of a bucket is compared with the bucket's pivot only, by likelihood: what may link gets one label;
3. members of buckets that still hold several labels are compared across labels, in blocks of ``BLOCK`` sketches on
   each side; a task returns a spanning forest of what may link. Now any two that share a bucket and may link have the
   same label, and a label's members are a family;
4. families are verified on full sets, and a task returns a spanning forest of the links. Members of a large family are
first compared with ``PIVOTS`` of them, a block of members a task; what is not linked with that of them that has most links
is then compared with all members, block against block. What hangs together already, as all that the pivot is linked with
does, counts as one, and a member has nothing left to compare with once it hangs on it too.
So what leaves a task grows with the members, never with their pairs, and the texts that are moved grow with the members as
well, while no more than ``BLOCK`` of a family stay apart. Small buckets and families are dealt
to as many tasks as their rows and shingles need. Components of the links are the result. A pair at
the threshold s shares a bucket but for a probability of (1 - s**ROWS)**BANDS: 2e-8 at 0.85, 3e-6 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import connected_components
from .storage import cut

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: SetSketch parameters for two-byte registers: base, rate, highest level.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Sketches on one side of a block of comparisons in one task.
BLOCK = 2048
#: Members that all of a large family are compared with first.
PIVOTS = 4
#: Sketches, and shingles, of the small buckets and families that one task has, about.
TASK_SKETCHES, TASK_SHINGLES = 16384, 1_000_000
#: Rows of hashes that are counted at a time.
POSTINGS = 1 << 22
#: Log-likelihood by which the best similarity may beat the best one that reaches the threshold; e**-16 is about 1e-7.
SLACK = 16.0
_RNG = np.random.Generator(np.random.PCG64(8191))
_MUL = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=low)
    share = np.minimum((low.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)
    level = np.floor(1 - np.log(-np.log1p(-share) / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 201)


def may_link(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a pair may reach the threshold, by the joint likelihood of the registers' order given both set sizes.
    above, below: registers in which a's is the larger, the smaller."""
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    ok = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    out = np.zeros(len(n_a), bool)
    for at in range(0, len(n_a), 4096):
        rows = slice(at, at + 4096)
        u = (n_a[rows] / (n_a[rows] + n_b[rows]))[:, None]
        v = 1 - u
        j = _GRID * np.minimum(u / v, v / u)
        part = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
        p, q = part(u - v * j), part(v - u * j)
        more, less = above[rows, None], below[rows, None]
        fit = more * np.log(p) + less * np.log(q) + (REGISTERS - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))
        reach = np.where(j >= threshold - 0.005, fit, -np.inf).max(axis=1)
        out[rows] = reach >= fit.max(axis=1) - SLACK
    return out & ok


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, regs) for each row: set size, 128 bits that name the set, registers (little-endian)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h in map(T.shingles, T.words(batch["text"])):
                name = T.mix(h + np.uint64(0x632BE59BD9B4E019))
                out.append((len(h), int(name.sum().astype(np.int64)), int(np.bitwise_xor.reduce(name).astype(np.int64)) if len(h) else 0, registers(h).astype("<u2").tobytes()))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "k1", "k2", "regs"])], axis=1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n long, k1 long, k2 long, regs binary")


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (src, dst) those that may link."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("regs").alias(f"{c}_regs"), F.col("n").alias(f"{c}_n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a, b = (np.frombuffer(b"".join(x[f"{c}_regs"]), "<u2").reshape(-1, REGISTERS) for c in ("src", "dst"))
                yield x.loc[may_link((a > b).sum(1), (a < b).sum(1), x["src_n"].to_numpy(), x["dst_n"].to_numpy(), threshold), ["src", "dst"]]

    return pairs.join(side("src"), "src").join(side("dst"), "dst").mapInPandas(run, "src long, dst long")


class _Forest:
    """Edges that join what was not joined before; ``of`` tells to which tree each row belongs."""

    def __init__(self, of: np.ndarray):
        self.of, self.edges = np.unique(of, return_inverse=True)[1], []

    def join(self, i: int, j: int) -> None:
        if self.of[i] != self.of[j]:
            self.edges.append((i, j))
            self.of[self.of == self.of[j]] = self.of[i]


def _promising(regs: np.ndarray, n: np.ndarray, row: int, others: np.ndarray, threshold: float, forest: _Forest) -> Iterator[np.ndarray]:
    """Those of the rows ``others`` that may link with ``row``, in parts, the likeliest first; what has been joined with the
    row meanwhile is left out, so in a family that hangs together few are ever tested. Equal registers are counted
    first: fewer than the likelihood test could pass need no test."""
    others = others[(forest.of[others] != forest.of[row]) & (np.minimum(n[others], n[row]) >= threshold * np.maximum(n[others], n[row]) - 1e-9)]
    same = (regs[others] == regs[row]).sum(axis=1)
    keep = same >= 0.5 * threshold * REGISTERS
    others = others[keep][np.argsort(-same[keep], kind="stable")]
    size = 16
    while len(others):
        part, others = others[:size], others[size:]
        theirs, mine = regs[part], regs[row]
        part = part[may_link((theirs < mine).sum(1), (theirs > mine).sum(1), np.full(len(part), n[row]), n[part], threshold)]
        if len(part):
            yield part
            others = others[forest.of[others] != forest.of[row]]
        size = min(4 * size, 4096)


def _across_labels(members: DataFrame, tasks: int, threshold: float) -> DataFrame:
    """Pairs (src, dst) of different labels that may link, as spanning forests, of members (key, rep, label, n, regs,
    rest, blocks, rest_blocks). A task has a block of a large bucket, or many small buckets together, in ``tasks`` of them."""
    sides = members.withColumns({"yb": F.when(F.col("rest"), F.pmod(F.xxhash64("rep"), "rest_blocks")), "mb": F.pmod(F.xxhash64("rep", F.lit(1)), "blocks")})
    ys = sides.filter("rest").withColumns({"side": F.lit(0), "mb": F.explode(F.expr("sequence(0L, blocks - 1)"))})
    ms = sides.withColumns({"side": F.lit(1), "yb": F.explode(F.expr("sequence(0L, rest_blocks - 1)"))})
    both = ys.unionByName(ms).withColumn("task", F.when(F.col("blocks") + F.col("rest_blocks") > 2, F.xxhash64("key", "yb", "mb")).otherwise(F.pmod("key", F.lit(tasks))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(group["regs"]), "<u2").reshape(-1, REGISTERS)
        rep, label, n, side = (group[c].to_numpy() for c in ("rep", "label", "n", "side"))
        forest = _Forest(label)
        for at in group.groupby(["key", "yb", "mb"], sort=False).indices.values():
            y, m = at[side[at] == 0], at[side[at] == 1]
            for row in y:
                for near in _promising(regs, n, row, m, threshold, forest):
                    for other in near:
                        forest.join(row, other)
        out = [(rep[i], rep[j]) for i, j in forest.edges]
        return pd.DataFrame(out, columns=["src", "dst"])

    return both.groupBy("task").applyInPandas(run, "src long, dst long")


class _Postings:
    """The rows of a list of sets that hold each hash, to count what a row shares with all others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.rows, self.ends = len(sets), np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        code = np.cumsum(np.diff(flat, prepend=flat[:1]) != 0, dtype=np.int32)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(code))))
        self.who = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.ends))[order]
        self.code = np.empty(len(code), np.int32)
        self.code[order] = code

    def shared(self, row: int) -> np.ndarray:
        """How many hashes of a row each row has, by at most POSTINGS or one hash's at a time."""
        own = self.code[self.ends[row] : self.ends[row + 1]]
        begin, size = self.starts[own], self.starts[own + 1] - self.starts[own]
        upto, out, k = np.concatenate(([0], np.cumsum(size))), np.zeros(self.rows, np.int64), 0
        while k < len(own):
            stop = max(k + 1, int(np.searchsorted(upto, upto[k] + POSTINGS, side="right")) - 1)
            at = np.repeat(begin[k:stop] - upto[k:stop], size[k:stop]) + np.arange(upto[k], upto[stop])
            out += np.bincount(self.who[at], minlength=self.rows)
            k = stop
        return out


def _checked(met: DataFrame, threshold: float) -> DataFrame:
    """Spanning forests (src, dst) of the links, on full sets, of rows (task, part, rep, text, side, joined): within a part
    of a task, rows of side 0 are compared with each other and with those of side 1. Rows of a part that are ``joined``
    are known to hang together, and their links to be told elsewhere. Texts are moved and hashed again, as they are half
    as large as the sets of hashes."""
    per = int(round(threshold * 100))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", kind="stable").reset_index(drop=True)  # pivots come in the same order in all tasks
        sets = [T.shingles(h) for h in T.words(group["text"])]
        rep, side = group["rep"].to_numpy(), group["side"].to_numpy()
        hang = group.groupby(["part", "joined", group["rep"].where(~group["joined"], 0)], sort=False).ngroup()
        forest = _Forest(hang.to_numpy())  # a row that is on both sides is one as well
        for at in group.groupby("part", sort=False).indices.values():
            postings, n = _Postings([sets[x] for x in at]), np.array([len(sets[x]) for x in at])
            for k in np.flatnonzero(side[at] == 0):
                open_ = forest.of[at] != forest.of[at[k]]
                if open_.any():
                    both = postings.shared(k)
                    for x in at[open_ & (100 * both >= per * (n[k] + n - both)) & (both > 0)]:
                        forest.join(at[k], x)
        return pd.DataFrame([(rep[i], rep[j]) for i, j in forest.edges], columns=["src", "dst"])

    return met.groupBy("task").applyInPandas(run, "src long, dst long")


def _verified(families: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Spanning forests (src, dst) of the links within families (rep, label, n)."""
    sizes = families.groupBy("label").agg(F.count("*").alias("size"), F.min_by("rep", F.xxhash64("rep")).alias("p0"), *(F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in range(1, PIVOTS)))
    placed = families.join(sizes.filter("size > 1"), "label")
    own = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = cut(own.join(placed.select("rep", "label", "n", "size", *(f"p{k}" for k in range(PIVOTS))), "rep").dropDuplicates(["rep"]))

    small = texts.filter(F.col("size") <= BLOCK)
    tasks = 1 + int(small.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES
    links = _checked(small.select(F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("task"), F.col("label").cast("string").alias("part"), "rep", "text", F.lit(0).alias("side"), F.lit(False).alias("joined")), threshold)
    large = texts.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return links

    # all members of a large family against its pivots; a pivot goes to each block of members
    blocks = lambda size: F.ceil(size / F.lit(BLOCK)).cast("long")
    pivot = F.array(*(F.col(f"p{k}") for k in range(PIVOTS)))
    members = large.select(F.xxhash64("label", F.pmod(F.xxhash64("rep", F.lit(2)), blocks(F.col("size")))).alias("task"), "rep", "text", F.lit(1).alias("side"))
    pivots = large.filter(F.array_contains(pivot, F.col("rep"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("size")) - 1)))
    pivots = pivots.select(F.xxhash64("label", "b").alias("task"), "rep", "text", F.lit(0).alias("side"))
    star = cut(_checked(members.unionByName(pivots).withColumns({"part": F.lit(""), "joined": F.lit(False)}), threshold))

    # what the pivot with most links is not linked with itself, against all members
    found = star.join(large.select(F.col("rep").alias("src"), "label"), "src")
    main = found.groupBy("label", "src").count().groupBy("label").agg(F.max_by("src", F.struct("count", "src")).alias("main"))
    near = found.join(main, "label").filter("src = main").select(F.explode(F.array("dst", "main")).alias("rep")).distinct()
    apart = cut(large.select("rep", "label").join(near, "rep", "left_anti"))
    count = apart.groupBy("label").agg(F.count("*").alias("n_apart"))
    rest = large.join(cut(count), "label").withColumns({"bs": blocks(F.col("size")), "rs": blocks(F.col("n_apart"))})
    rest = rest.join(apart.select("rep", F.lit(False).alias("joined")), "rep", "left").withColumn("joined", F.coalesce("joined", F.lit(True)))
    sides = [
        rest.filter("NOT joined").withColumns({"rb": F.pmod(F.xxhash64("rep"), "rs"), "mb": F.explode(F.expr("sequence(0L, bs - 1)")), "side": F.lit(0)}),
        rest.withColumns({"rb": F.explode(F.expr("sequence(0L, rs - 1)")), "mb": F.pmod(F.xxhash64("rep", F.lit(1)), "bs"), "side": F.lit(1)}),
    ]
    both = sides[0].unionByName(sides[1]).select(F.xxhash64("label", "rb", "mb").alias("task"), F.lit("").alias("part"), "rep", "text", "side", "joined")
    return links.unionByName(star).unionByName(_checked(both, threshold))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; more columns are ignored).

    Two documents link if their shingle sets' Jaccard similarity reaches ``threshold`` (a multiple of 0.01). A null or
    blank text has an empty set and links with nothing, and is its own component; rows with a null doc_id are left
    out; rows that repeat a doc_id repeat its result, and their texts should be equal; an empty table gives an empty
    result. Kept is the smallest id of each component."""
    known = cut(sketches(docs.filter("doc_id is not null")))
    name = ["n", "k1", "k2"]
    reps = cut(known.filter("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep"), F.max("regs").alias("regs")))
    bands = reps.select("rep", F.posexplode(F.array(*(F.substring("regs", 1 + 2 * ROWS * i, 2 * ROWS) for i in range(BANDS)))).alias("band", "part")).select("rep", F.xxhash64("band", "part").alias("key"))
    pivots = bands.groupBy("key").agg(F.count("*").alias("members"), F.min_by("rep", F.xxhash64("rep")).alias("pivot")).filter("members > 1")
    buckets = cut(bands.join(cut(pivots), "key"))  # a table of its own, so that a hot key's join can be split
    star = buckets.filter("rep != pivot").select(F.least("rep", "pivot").alias("src"), F.greatest("rep", "pivot").alias("dst")).distinct()
    near = cut(_estimated(star, reps, threshold))
    labels = connected_components(near).select(F.col("id").alias("rep"), F.col("component").alias("label"))

    labelled = buckets.select("key", "rep").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("members"), F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most")).filter("labels > 1")
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("long")
    mixed = cut(mixed)
    tasks = 1 + int(mixed.filter(F.col("members") <= BLOCK).agg(F.sum("members")).first()[0] or 0) // TASK_SKETCHES
    members = labelled.join(mixed, "key").select("key", "rep", "label", (F.col("label") != F.col("main")).alias("rest"), blocks(F.col("members")).alias("blocks"), blocks(F.col("members") - F.col("most")).alias("rest_blocks"))
    more = cut(_across_labels(members.join(reps.select("rep", "n", "regs"), "rep"), tasks, threshold))

    families = connected_components(near.union(more)).select(F.col("id").alias("rep"), F.col("component").alias("label"))
    links = _verified(families.join(reps.select("rep", "n"), "rep"), docs, threshold)

    linked = connected_components(links).select(F.col("id").alias("rep"), "component")
    of_set = reps.select(*name, "rep").join(linked, "rep", "left").select(*name, F.coalesce("component", "rep").alias("c"))
    out = known.join(of_set, name, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
