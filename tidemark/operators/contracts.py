"""Contracts that are checked in passing: an action counts what breaks them while it runs, and no job of its own is needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


@dataclass
class Watch:
    """What an action has counted; ``verify`` after it, before its result is used."""

    observation: Observation
    message: str

    def verify(self) -> None:
        """Raise ValueError with the first row, by its key, that broke the contract. Waits for the action, which must read
        all rows (a write does, ``take`` does not)."""
        found = self.observation.get
        if found["broken"]:
            raise ValueError(self.message.format(*found["first"]))


def watch(df: DataFrame, broken: Column, key: list[str], message: str) -> tuple[DataFrame, Watch]:
    """df, and the watch over its rows for which ``broken`` holds. ``message`` is filled with the key's values."""
    observation = Observation()
    broken = F.coalesce(broken, F.lit(False))
    first = F.min(F.when(broken, F.struct(*(F.col(k).cast("string").alias(k) for k in key))))
    return df.observe(observation, F.count_if(broken).alias("broken"), first.alias("first")), Watch(observation, message)


def watch_unique(df: DataFrame, by: str, on: str) -> tuple[DataFrame, Watch]:
    """df, and the watch over keys (by, on) that are null or repeated. Rows are laid next to those of the same ``by`` in the
    order of ``on``, as windows by symbol and date do anyway, so it costs no shuffle beside theirs."""
    repeated = F.lag(on).over(Window.partitionBy(by).orderBy(on)).eqNullSafe(F.col(on)) & (F.row_number().over(Window.partitionBy(by).orderBy(on)) > 1)
    marked = df.withColumn("_repeated", repeated)
    out, watched = watch(marked, F.col("_repeated") | F.col(by).isNull() | F.col(on).isNull(), [by, on], f"null or repeated key {by} {{0}}, {on} {{1}}")
    return out.drop("_repeated"), watched
