"""As-of join: to each left row the right row with the latest effective date not after its own.

Each side becomes rows of one table, and one window over it carries the last right row on: one shuffle for any number
of right sides, and no pair is ever built. The right payload travels as a struct, so a row with null fields still
hides an older one. A left row sees a right row of the same date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Right:
    """A right side: rows unique by (by, on); ``on`` is its effective date, ``columns`` what it adds."""

    df: DataFrame
    on: str
    columns: list[str]
    how: str = "inner"


def asof_join(left: DataFrame, *rights: Right, by: str = "symbol", on: str = "date") -> DataFrame:
    """left with the columns of the rights; a left row without match goes if the side is ``inner`` and stays with nulls
    if it is ``left``. Right rows with a null date match nothing."""
    own = F.struct(*(F.col(c) for c in left.columns if c not in (by, on)))
    sides = [left.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(1).alias("_side"), own.alias("_left"))]
    for k, r in enumerate(rights):
        sides.append(r.df.filter(F.col(r.on).isNotNull()).select(F.col(by).alias("_by"), F.col(r.on).alias("_on"), F.lit(0).alias("_side"), F.struct(*r.columns).alias(f"_r{k}")))
    table = sides[0]
    for s in sides[1:]:
        table = table.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("_by").orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumns({f"_r{k}": F.last(f"_r{k}", ignorenulls=True).over(w) for k in range(len(rights))}).filter("_side = 1")
    for k, r in enumerate(rights):
        if r.how == "inner":
            table = table.filter(F.col(f"_r{k}").isNotNull())
    return table.select(F.col("_by").alias(by), F.col("_on").alias(on), "_left.*", *(F.col(f"_r{k}")[c].alias(c) for k, r in enumerate(rights) for c in r.columns))


def last_state(*rights: Right, upto: Column, by: str = "symbol") -> DataFrame:
    """(by, _r0, _r1, ...): of each right side the last row with a date up to ``upto``, as a struct of that date (``on``)
    and its columns; null without one. That is all that later left rows need of the past."""
    rows = None
    for k, r in enumerate(rights):
        one = r.df.filter(F.col(r.on) <= upto).select(by, F.struct(F.col(r.on).alias("on"), *r.columns).alias(f"_r{k}"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.groupBy(by).agg(*(F.max_by(f"_r{k}", F.col(f"_r{k}.on")).alias(f"_r{k}") for k in range(len(rights))))


def with_state(state: DataFrame, *fresh: Right, by: str = "symbol") -> list[Right]:
    """Right sides of what a state remembers and the rows that came after it."""
    out = []
    for k, r in enumerate(fresh):
        known = state.filter(F.col(f"_r{k}").isNotNull()).select(by, F.col(f"_r{k}.on").alias(r.on), *(F.col(f"_r{k}.{c}").alias(c) for c in r.columns))
        out.append(Right(known.unionByName(r.df.select(by, r.on, *r.columns)), r.on, r.columns, r.how))
    return out
