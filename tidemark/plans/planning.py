"""What to fetch next: high-water marks, ranges, target symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import normalize_date
from tidemark.operators.dedupe import keep_last
from tidemark.sources.store import Layout, Store

FIRST = "1990-01-01"


def high_water_marks(rows: DataFrame, universe: DataFrame | None = None, on: str = "date") -> DataFrame:
    """(symbol, mark): the last date of each symbol; symbols of ``universe`` without rows have FIRST."""
    marks = rows.groupBy("symbol").agg(F.max(on).alias("mark"))
    if universe is None:
        return marks
    return universe.select("symbol").distinct().join(marks, "symbol", "left").withColumn("mark", F.coalesce("mark", F.lit(FIRST).cast("date")))


def beyond_marks(rows: DataFrame, marks: DataFrame, on: str = "date") -> DataFrame:
    """Rows after their symbol's mark; symbols without a mark are new."""
    return rows.join(marks.select("symbol", "mark"), "symbol", "left").filter(F.col("mark").isNull() | (F.col(on) > F.col("mark"))).drop("mark")


def ranges(marks: DataFrame, session: Column, attempted: DataFrame | None = None) -> DataFrame:
    """(symbol, start, end): from the day after the mark (FIRST itself without rows) to the latest closed session; symbols that
    are up to date, or in ``attempted``, are left out."""
    begin = F.when(F.col("mark") == F.lit(FIRST).cast("date"), F.col("mark")).otherwise(F.date_add("mark", 1))
    out = marks.select("symbol", begin.alias("start"), session.alias("end")).filter(F.col("start") <= F.col("end"))
    return out if attempted is None else out.join(attempted.select("symbol"), "symbol", "left_anti")


def sync_targets(universe: DataFrame, disclosed: DataFrame, stored: DataFrame, pending: DataFrame | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """(symbol, reasons): symbols of the universe with a disclosed period that is not stored (disclosed: symbol, report_date,
    actual_date; rows without a parsable actual date do not count), without any stored row (``orphan``; but for those in
    ``incomplete``), or in ``pending``."""
    filed = disclosed.filter(normalize_date(F.col("actual_date")).isNotNull()).select("symbol", "report_date").distinct()
    parts = [filed.join(stored.select("symbol", "report_date"), ["symbol", "report_date"], "left_anti").select("symbol", F.lit("disclosed").alias("reason"))]
    orphans = universe.select("symbol").join(stored.select("symbol"), "symbol", "left_anti")
    if incomplete is not None:
        orphans = orphans.join(incomplete.select("symbol"), "symbol", "left_anti")
    parts.append(orphans.select("symbol", F.lit("orphan").alias("reason")))
    if pending is not None:
        parts.append(pending.select("symbol", F.lit("pending").alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(universe.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def record_sync(state: DataFrame, synced: DataFrame) -> DataFrame:
    """The sync table (dataset, symbol, last_sync_date) with new rows in place of old ones."""
    return keep_last(state, synced, ["dataset", "symbol"])


def synced_since(state: DataFrame, dataset: str, day: Column) -> DataFrame:
    return state.filter((F.col("dataset") == dataset) & (F.col("last_sync_date") >= day)).select("symbol")


@dataclass
class SyncState:
    """The sync table as stored: the day of the last sync by dataset and symbol; a dataset is a folder, so a run reads and
    rewrites what it asks about."""

    store: Store

    @staticmethod
    def at(spark: SparkSession, path: str, buckets: int = 4) -> SyncState:
        return SyncState(Store(spark, path, Layout("dataset STRING, symbol STRING, last_sync_date DATE", ("dataset", "symbol"), buckets=buckets, folders=("dataset",))))

    def _rows(self, dataset: str, symbols: DataFrame, day: Column) -> DataFrame:
        return symbols.select(F.lit(dataset).alias("dataset"), "symbol", day.cast("date").alias("last_sync_date")).distinct()

    def record(self, dataset: str, symbols: DataFrame, day: Column) -> int:
        return self.store.upsert(self._rows(dataset, symbols, day))

    def clear(self, dataset: str, symbols: DataFrame) -> int:
        return self.store.delete(self._rows(dataset, symbols, F.lit(None)))

    def known(self, dataset: str) -> DataFrame:
        """(symbol, last_sync_date) of a dataset."""
        return self.store.read(F.col("dataset") == dataset).select("symbol", "last_sync_date")

    def due(self, dataset: str, universe: DataFrame, day: Column) -> DataFrame:
        """The symbols of the universe that a dataset has not been synced for since ``day``."""
        return universe.select("symbol").distinct().join(synced_since(self.store.read(F.col("dataset") == dataset), dataset, day), "symbol", "left_anti")
