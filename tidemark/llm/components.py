"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, forget


def _to_min(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of its neighbourhood. ``only_larger``: the neighbours above
    the node (a large star); else those below it and itself (a small star). Minima are partially aggregated before
    the shuffle, and the join's skewed keys are split by AQE."""
    if only_larger:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    met = both.join(least, "src")
    if only_larger:
        return met.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
    return met.filter("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst"))).filter("src != dst").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each id hangs on one other, which hangs on none: then those are the smallest of their components."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in ``edges`` (src, dst: bigint); loops and repeated or
    reversed edges are allowed, rows with a null end are left out. An empty table gives none. Raises if it has not
    converged in ``max_rounds`` (rounds grow with the logarithm of the longest path)."""
    now = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        if _stars(now):
            break
        after = cut(_to_min(_to_min(now, True), False))
        forget(now)
        now = after
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(now.select(F.col("dst"), F.col("dst")).distinct())
