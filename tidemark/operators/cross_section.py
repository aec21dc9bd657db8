"""Cross-sectional transforms: over all symbols of a date."""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct_rank(x: str, ascending: bool = True, by: str = "date") -> Column:
    """Rank over the number of non-null values, ties at their average; null stays null."""
    order = F.asc_nulls_last(x) if ascending else F.desc_nulls_last(x)
    ties = F.count("*").over(Window.partitionBy(by, x))
    rank = F.rank().over(Window.partitionBy(by).orderBy(order))
    return F.when(F.col(x).isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(by)))


def winsorize(x: str, lower: float, upper: float, by: str = "date") -> Column:
    """Clipped to the linearly interpolated quantiles of the date; null stays null."""
    w = Window.partitionBy(by)
    low, high = F.percentile(x, F.lit(lower)).over(w), F.percentile(x, F.lit(upper)).over(w)
    return F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), low), high))


def winsorized(df: DataFrame, columns: list[str], lower: float, upper: float, by: str = "date") -> DataFrame:
    """df with ``columns`` clipped as by ``winsorize``: one aggregate finds the quantiles of all of them, a row a date, and
    a join brings them back, instead of two windows a column."""
    bounds = df.groupBy(by).agg(*(F.percentile(c, [lower, upper]).alias(f"_q{k}") for k, c in enumerate(columns)))
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_q{k}")[0]), F.col(f"_q{k}")[1])) for k, c in enumerate(columns)}
    return df.join(bounds, by).withColumns(clipped).select(*df.columns)


def zscore(x: str, by: str = "date") -> Column:
    """(x - mean) / population deviation; 0 where that is 0."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop(x).over(w)
    return F.when(F.col(x).isNotNull(), F.when(sd == 0, 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0))))


def combine(weights: dict[str, float]) -> Column:
    """Weighted sum, null if a part is; weights must be finite and not all zero."""
    if not weights or not all(isfinite(w) for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must be finite and not all zero")
    return reduce(lambda a, b: a + b, (F.col(c) * F.lit(float(w)) for c, w in weights.items()))


def place(x: str, ascending: bool = False, by: str = "date", tie: str = "symbol") -> Column:
    """1, 2, ... by x, ties by ``tie``. Where a filter asks for the first n, each task keeps only its own first n of a date, and
    no date is moved as a whole."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(x) if ascending else F.desc_nulls_last(x), tie))


def ordinal_rank(x: str, ascending: bool = False, by: str = "date", tie: str = "symbol") -> Column:
    """``place``, but null x has no rank."""
    return F.when(F.col(x).isNotNull(), place(x, ascending, by, tie))
