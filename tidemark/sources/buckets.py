"""Tables that lie in buckets of the symbol, so that joins and windows by symbol need no shuffle.

Written once with the same number of buckets, bars, share capital, filings and figures meet bucket by bucket: the union of
an as-of join keeps the buckets' partitioning, and so do its window and later windows by symbol. A filter on the symbol
opens one bucket. A bucket is one task, so their number should suit the largest table; a symbol that is too long for a
task is for ``factors.calculate_sliced``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.storage import shared_dir


def write_bucketed(df: DataFrame, name: str, buckets: int, order: tuple[str, ...] = (), path: str | None = None) -> None:
    """Save df as the catalog's table ``name``, one sorted file a bucket; at ``path``, or in the shared folder."""
    spread = df.repartition(buckets, "symbol").write.mode("overwrite").format("parquet")
    spread.bucketBy(buckets, "symbol").sortBy("symbol", *order).option("path", path or f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)


def bucketed(spark: SparkSession, name: str, buckets: int | None = None) -> DataFrame:
    """The table, after a check that it lies in that many buckets; tables with other numbers would be shuffled."""
    if buckets is not None:
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        if told.get("Num Buckets") != str(buckets):
            raise ValueError(f"{name} has {told.get('Num Buckets')} buckets, not {buckets}")
    return spark.table(name)
