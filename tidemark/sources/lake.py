"""A lake of the bridge's tables, written by the library's writers and read with its declared schemas.

The queries over the lake, and the benchmark, start from it as a user's queries start from stored files: a dataset is written
once in a session into the shared folder, when it is first asked for, and read by scans.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.storage import drop, shared_dir
from tidemark.plans import ingest, ttm
from tidemark.sources import bridge, scans

_BUILT: dict[tuple[str, str], tuple[str, set[str]]] = {}
#: Columns of the indicator dictionary: a key of the source, and the name that the lake has for it.
INDICATORS = {"DEDUCT_NET": "扣非净利润(元)", "ROE_WEIGHTED": "净资产收益率_加权(%)", "OCF_TO_REVENUE": "经营现金流/营业收入"}
#: Symbols that a task writes where each has a folder of its own.
SYMBOLS_A_TASK = 200


def _lake_named(df: DataFrame) -> DataFrame:
    return df.toDF(*({v: k for k, v in scans.LAKE_NAMES.items()}.get(c, c) for c in df.columns))


def _write(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    stored = lambda other: spark.read.parquet(folder(spark, sf_dir, other))
    if name in ("daily_kline", "share_capital", "filings"):
        ingest.write_dataset(bridge.table(spark, sf_dir, name), path)
    elif name == "share_capital_by_symbol":  # a file a symbol, so it costs a folder a symbol; only who needs the paths asks for it
        rows = stored("share_capital")
        ingest.write_dataset(rows, path, "symbol", 1 + rows.select("symbol").distinct().count() // SYMBOLS_A_TASK)
    elif name == "etf_kline":
        etf = stored("daily_kline").filter("cast(symbol AS int) % 10 = 3").withColumn("volume", F.floor(F.col("volume") * 100).cast("long"))
        ingest.write_dataset(ingest.upsert_bars(etf.filter("year(date) < 2000"), etf.filter("year(date) >= 1999")), path)
    elif name in scans.STATEMENTS.values():
        source = next(k for k, v in scans.STATEMENTS.items() if v == name)
        own = [f.name for f in scans.T.StructType.fromDDL(scans.SCHEMAS[name])]
        ingest.write_dataset(_lake_named(stored("filings").filter(F.col("source") == source).select(*own)), path)
    elif name == "fin_ttm":
        rows = ttm.ttm(stored("filings"))
        ingest.write_dataset(rows.filter("report_date < '20000101'"), path)
        ingest.write_dataset(rows, path)  # a full replace
    elif name == "calendar":
        ingest.write_dataset(stored("daily_kline").select(F.date_format("date", "yyyy-MM-dd").alias("trade_date")).distinct(), path)
    elif name == "indicators":
        names = F.array(*(F.struct(F.lit(k).alias("indicator_key"), F.lit(v).alias("name_cn")) for k, v in INDICATORS.items()))
        spark.range(1).select(F.inline(names)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"the lake has no {name}")


def folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a dataset in the lake of ``sf_dir``; written, with those it is made from, when it is first asked for in
    a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = (f"{shared_dir(spark)}/lake-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}", set())
        atexit.register(drop, spark, _BUILT[key][0])
    root, have = _BUILT[key]
    if name not in have:
        _write(spark, sf_dir, name, f"{root}/{name}")
        have.add(name)
    return f"{root}/{name}"


def build(spark: SparkSession, sf_dir: str) -> None:
    """Write all datasets now, but for the one with a folder a symbol."""
    for name in (*scans.SCHEMAS, "calendar", "indicators"):
        folder(spark, sf_dir, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the lake by its declared schema; ``filings``: the four sources as one."""
    if name == "filings":
        return scans.filings(spark, {s: folder(spark, sf_dir, n) for s, n in scans.STATEMENTS.items()}, lake_names=True)
    return scans.dataset(spark, folder(spark, sf_dir, name), name, lake_names=name in scans.STATEMENTS.values())
