"""Choosing one row per key; every order ends in all columns, so that it never depends on the rows' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, ties by all other columns in descending order."""
    rest = [F.desc_nulls_last(c) for c in df.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: all rows of both, the new one where a key is in both; columns missing on one side are null."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, F.desc("_batch")).drop("_batch")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that its keys are not null and unique; raises ValueError."""
    bad = df.groupBy(*keys).count().filter(" OR ".join([*(f"{k} IS NULL" for k in keys), "count > 1"])).take(1)
    if bad:
        raise ValueError(f"null or repeated key {bad[0].asDict()}")
    return df
