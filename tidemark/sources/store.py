"""Datasets that are kept up to date by rewriting only the folders that new rows touch.

A folder is named by values that the key of a row decides: columns such as the source, the year of its date, a bucket of
its symbol. So the folders that a batch can change are known from its keys alone: they are gathered from the batch, the
stored table is read under that filter, which prunes folders before any file is opened, merged, and written back by a
dynamic overwrite, all folders in one job. What a batch costs follows what it touches, not what is stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import keep_last
from tidemark.operators.storage import cut, drop, exists, forget

#: Folders that a filter names one by one; a batch that touches more is filtered by the first level of folders.
NAMED = 20_000


@dataclass(frozen=True)
class Layout:
    """A declared schema, its key, and the folders: ``folders`` are columns of the key, then the year of ``on`` (a date,
    or a text that begins with a year), then ``buckets`` of the symbol (0: none). ``together``: folders that are always
    rewritten with each other, as the rows of a period are when dates of all its sources are reconciled."""

    schema: str
    keys: tuple[str, ...]
    on: str | None = None
    buckets: int = 16
    folders: tuple[str, ...] = ()
    together: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if missing := {*self.folders, *filter(None, [self.on]), "symbol"} - set(self.keys):
            raise ValueError(f"folders must follow from the key, which lacks {sorted(missing)}")

    @property
    def levels(self) -> list[str]:
        return [*self.folders, *(["_year"] if self.on else []), *(["_bucket"] if self.buckets else [])]

    @property
    def columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).names

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows in the declared columns and types (missing ones are null), with their folders' columns."""
        own = {c.lower() for c in rows.columns}
        out = rows.select(*((F.col(f"`{f.name}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.schema)))
        if self.on:
            year = F.year(self.on) if isinstance(out.schema[self.on].dataType, T.DateType) else F.substring(self.on, 1, 4).try_cast("int")
            out = out.withColumn("_year", F.coalesce(year, F.lit(0)))
        return out.withColumn("_bucket", bucket(F.col("symbol"), self.buckets)) if self.buckets else out

    def whole_schema(self) -> T.StructType:
        own = T.StructType.fromDDL(self.schema)
        return T.StructType([*(f for f in own if f.name not in self.folders), *(own[c] for c in self.folders), *(T.StructField(c, T.IntegerType()) for c in self.levels if c.startswith("_"))])


def bucket(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def only(rows: list, levels: list[str]) -> Column:
    """Whether a row lies in one of the given folders."""
    if not levels:
        return F.lit(True)
    lead: dict[tuple, set] = {}
    for r in rows:
        lead.setdefault(tuple(r[c] for c in levels[:-1]), set()).add(r[levels[-1]])
    same: dict[frozenset, list[tuple]] = {}  # folders of one level that go on alike share a list
    for k, last in lead.items():
        same.setdefault(frozenset(last), []).append(k)
    parts = []
    for last, keys in same.items():
        tests = [F.col(levels[-1]).isin(*sorted(last, key=str))]
        if len(levels) > 1:
            tests.append(only([dict(zip(levels[:-1], k, strict=True)) for k in keys], levels[:-1]))
        parts.append(reduce(lambda a, b: a & b, tests))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


@dataclass
class Store:
    spark: SparkSession
    path: str
    layout: Layout

    def read(self, where: Column | None = None) -> DataFrame:
        """The stored rows in declared columns; ``where`` may name the folders' columns ``_year`` and ``_bucket``."""
        rows = self._stored()
        return (rows if where is None else rows.filter(where)).select(*self.layout.columns)

    def of(self, symbols: DataFrame) -> DataFrame:
        """The rows of some symbols, from their buckets only."""
        rows = self._stored()
        if self.layout.buckets:
            rows = rows.filter(F.col("_bucket").isin(*self.buckets_of(symbols)))
        return rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select(*self.layout.columns)

    def buckets_of(self, symbols: DataFrame) -> list[int]:
        return sorted(r["b"] for r in symbols.select(bucket(F.col("symbol"), self.layout.buckets).alias("b")).distinct().collect())

    def _stored(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.layout.whole_schema())
        return self.spark.read.schema(self.layout.whole_schema()).parquet(self.path)

    def touched(self, placed: DataFrame) -> tuple[list, list[str]]:
        """The folders that rows lie in, but for those that are rewritten together: one row each, at most as many as
        the dataset can have folders, and their levels. Of more than NAMED only the first level."""
        levels = [c for c in self.layout.levels if c not in self.layout.together]
        found = placed.select(*levels).distinct()
        rows = found.limit(NAMED + 1).collect()
        return (rows, levels) if len(rows) <= NAMED else (found.select(levels[0]).distinct().collect(), levels[:1])

    def upsert(self, new: DataFrame, after: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Merge rows by key, the new one where both have it, and pass what is in the touched folders through ``after``;
        gives the number of folders written. A repeated batch gives the same table. No rows: nothing is written."""
        placed = self.layout.placed(new)
        placed = placed if hasattr(new, "_cut_path") else cut(placed, keep=False)  # what ``cut`` has written is not copied again
        rows, levels = self.touched(placed)
        if not rows:
            forget(placed)
            return 0
        stored = self._stored().filter(only(rows, levels))
        merged = keep_last(stored, placed, list(self.layout.keys))
        done = self._rewrite(self.layout.placed(after(merged) if after else merged), stored)
        forget(placed)
        return done

    def delete(self, rows: DataFrame) -> int:
        """The stored rows with the keys of ``rows`` go; gives the number of folders that are still there of those rewritten."""
        placed = cut(self.layout.placed(rows).select(*dict.fromkeys([*self.layout.keys, *self.layout.levels])).distinct(), keep=False)
        named, levels = self.touched(placed)
        stored = self._stored().filter(only(named, levels))
        same = [stored[k].eqNullSafe(placed[k]) for k in self.layout.keys]
        done = self._rewrite(self.layout.placed(stored.join(placed, reduce(lambda a, b: a & b, same), "left_anti")), stored) if named else 0
        forget(placed)
        return done

    def replace(self, new: DataFrame, symbols: DataFrame) -> int:
        """All rows of ``symbols`` go and new ones come, which are of these symbols only; folders of their buckets are
        rewritten. Gives the number of folders written."""
        if not (numbers := self.buckets_of(symbols)):
            return 0
        gone = symbols.select("symbol").distinct()
        stored = self._stored().filter(F.col("_bucket").isin(*numbers))
        rest = stored.join(gone, "symbol", "left_anti").select(*self.layout.columns)
        return self._rewrite(self.layout.placed(rest.unionByName(new.join(gone, "symbol", "left_semi").select(*self.layout.columns))), stored)

    def _rewrite(self, merged: DataFrame, stored: DataFrame) -> int:
        """Write the folders that merged has, and delete those of stored that it has no rows for any more."""
        levels, first = self.layout.levels, not exists(self.spark, self.path)
        merged = merged if first else cut(merged, keep=False)  # it reads what it overwrites
        have = merged.select(*levels).distinct().collect() if levels and not first else []
        had = stored.select(*levels).distinct().collect() if levels else []
        order = [c for c in (*self.layout.keys, *self.layout.columns[:1]) if c not in self.layout.folders]
        spread = merged.hint("rebalance", *levels) if levels else merged
        write = spread.sortWithinPartitions(*levels, *dict.fromkeys(order)).write.mode("overwrite")
        (write.option("partitionOverwriteMode", "dynamic").partitionBy(*levels) if levels else write.option("partitionOverwriteMode", "static")).parquet(self.path)
        if first and levels:
            have = self._stored().select(*levels).distinct().collect()
        for row in {tuple(r) for r in had} - {tuple(r) for r in have}:
            drop(self.spark, "/".join([self.path, *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(levels, row, strict=True))]))
        forget(merged)
        return len(have)


class Marked(Store):
    """A store that knows the last date of each symbol without reading its rows: marks lie beside it in the same buckets,
    and follow each upsert. They are written after the rows; should a job end in between, they lag, and what is fetched
    again is merged once more."""

    @property
    def marks(self) -> Store:
        return Store(self.spark, f"{self.path}-marks", Layout("symbol STRING, mark DATE", ("symbol",), buckets=self.layout.buckets))

    def upsert(self, new: DataFrame, after: Callable[[DataFrame], DataFrame] | None = None) -> int:
        done = super().upsert(new, after)
        last = new.groupBy("symbol").agg(F.max(F.col(self.layout.on).cast("date")).alias("mark"))
        known = self.marks.of(last) if done else None
        if known is not None:
            self.marks.upsert(last.unionByName(known).groupBy("symbol").agg(F.max("mark").alias("mark")))
        return done
