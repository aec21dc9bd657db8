"""Writing the lake: type enforcement, upserts, adjusted prices, result sets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.dedupe import keep_last
from tidemark.operators.storage import drop, exists, replace
from tidemark.plans import filings

#: Text columns of statements, all others are numbers.
STATEMENT_TEXT = ("symbol", "source", "report_date", "publish_date", "available_date", "update_date", "data_source", "audited", "currency", "type")
#: Text columns of indicators by the lake's names, and by this library's for those it renames. Fixed values.
INDICATOR_TEXT = ("report_date", "证券代码", "股票代码", "股票简称", "机构代码", "机构类型", "报告类型", "报告期名称", "证券类型代码", "公告日期", "数据可用日期", "更新日期", "币种", "其他_REPORT_YEAR", "symbol", "source", "publish_date", "available_date")
_NO_VALUE = ("nan", "None", "NaT", "<NA>")


def enforce_types(df: DataFrame, text: tuple[str, ...] = STATEMENT_TEXT) -> DataFrame:
    """Text columns as strings, missing values and their spellings as ''; all others as doubles, null if they are no number."""
    value = lambda c: F.col(f"`{c}`").cast("string")
    return df.select(*(F.when(value(c).isNull() | value(c).isin(*_NO_VALUE), "").otherwise(value(c)).alias(c) if c in text else F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double")).alias(c) for c in df.columns))


def clean_names(df: DataFrame, heads: tuple[str, ...] = ("其中:", "加:", "减:")) -> DataFrame:
    """Column names without leading qualifiers; of columns that become equal the first stays."""
    kept: dict[str, int] = {}
    for k, name in enumerate(df.columns):
        for h in (*heads, *(h.replace(":", "：") for h in heads)):
            name = name.strip().removeprefix(h)
        kept.setdefault(name.strip(), k)
    flat = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return flat.select(*(F.col(f"c{k}").alias(name) for name, k in kept.items()))


def translate_indicators(df: DataFrame, names: dict[str, str], keep: tuple[str, ...] = ("symbol", "report_date")) -> DataFrame:
    """Only the dictionary's columns, under its names without units in brackets at their end; other brackets become _."""
    import re

    def short(name: str) -> str:
        name = re.sub(r"[(（](元|%|次|天|倍|股|元/股)[)）]$", "", name)
        return re.sub(r"[)）]", "", re.sub(r"[(（]", "_", name))

    return df.select(*(c for c in keep if c in df.columns), *(F.col(f"`{k}`").alias(short(v)) for k, v in names.items() if k in df.columns and k not in keep))


def lots(shares: Column) -> Column:
    """Lots of a hundred shares."""
    return shares / 100


def upsert_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of stocks or ETFs: the new one of each (symbol, date)."""
    return keep_last(old, new, ["symbol", "date"])


def upsert_share_capital(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (symbol, change_date); counts are whole numbers, 0 where there is none."""
    return keep_last(old, new, ["symbol", "change_date"]).withColumn("total_shares", F.coalesce(F.round(F.col("total_shares").try_cast("double")).try_cast("long"), F.lit(0)))


def upsert_filings(old: DataFrame, new: DataFrame, text: tuple[str, ...] = STATEMENT_TEXT) -> DataFrame:
    """By (source, symbol, report_date), with types enforced, and the dates of all sources of a period reconciled."""
    rows = enforce_types(keep_last(old, new, ["source", "symbol", "report_date"]), text)
    return filings.reconcile(rows).select(*rows.columns)


def upsert_indicators(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (source, symbol, report_date), with the types of indicators."""
    return enforce_types(keep_last(old, new, ["source", "symbol", "report_date"]), INDICATOR_TEXT)


def adjustment_factors(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """raw bars with adj_factor = adjusted close / close of the same day (adjusted: symbol, date, close_hfq), carried forward,
    1.0 before the first."""
    met = raw.join(adjusted.select("symbol", "date", "close_hfq"), ["symbol", "date"], "left").withColumn("f", F.try_divide("close_hfq", "close"))
    return _carried(met, "close_hfq")


def adjustment_from_events(raw: DataFrame, events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """raw bars with adj_factor from sparse events (symbol, date, hfq_factor) that fall on a bar's day exactly, carried
    forward, 1.0 before; close_hfq with it. An event on a day without a bar has no effect. The cut to [start, end] comes
    after the carrying."""
    met = raw.join(events.select("symbol", "date", F.col("hfq_factor").alias("f")), ["symbol", "date"], "left")
    out = _carried(met).withColumn("close_hfq", F.col("close") * F.col("adj_factor"))
    for bound, test in ((start, "date >= date'{}'"), (end, "date <= date'{}'")):
        out = out.filter(test.format(bound)) if bound else out
    return out


def _carried(met: DataFrame, *drop: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("adj_factor", F.coalesce(F.last("f", ignorenulls=True).over(w), F.lit(1.0))).drop("f", *drop)


def write_dataset(df: DataFrame, path: str, partition: str | None = None, files: int = 0) -> bool:
    """Overwrite a dataset, or only the partitions that df has; an empty df writes nothing. Rows of a symbol lie together
    in date order, in ``files`` files (default: as shuffled), instead of one file a symbol. Partitions become visible one
    after the other; readers that need all at once should read a new path.

    df is computed once: the write counts its rows, beside the dataset, and takes its place if there are any."""
    by = [c for c in ("symbol", "date", "report_date", "change_date") if c in df.columns] or df.columns[:1]
    spread = df.repartition(files, by[0]) if files and by else df.repartition(by[0]) if by else df
    seen, spark = Observation(), df.sparkSession
    out = spread.sortWithinPartitions(*by).observe(seen, F.count(F.lit(1)).alias("n")).write
    if partition:
        known = exists(spark, path)
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        if not seen.get["n"] and not known:
            drop(spark, path)
    else:
        made = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        out.mode("errorifexists").parquet(made)
        if seen.get["n"]:
            replace(spark, made, path)
        else:
            drop(spark, made)
    return seen.get["n"] > 0


def out_of_order(rows: DataFrame, file: str, at: str, *order: str) -> DataFrame:
    """(symbol, rows, files, out_of_order): in how many files a symbol lies, and how many rows come before one that
    should precede them; ``at`` is a row's place in its file."""
    before = Window.partitionBy(file).orderBy(at)
    late = F.coalesce(F.struct(*order) < F.lag(F.struct(*order)).over(before), F.lit(False))
    return rows.withColumn("_late", late).groupBy("symbol").agg(F.count("*").alias("rows"), F.countDistinct(file).cast("int").alias("files"), F.count_if("_late").cast("int").alias("out_of_order"))


def write_results(path: str, nav: DataFrame, targets: DataFrame, trades: DataFrame, parameters: dict) -> None:
    """A result set under ``path``, which must not exist: daily_nav, rebalance_targets and trades as CSV, parameters as JSON."""
    for name, df, order in (("daily_nav", nav, ["date"]), ("rebalance_targets", targets, ["date", "symbol"]), ("trades", trades, ["date", "symbol"])):
        df.orderBy(*order).write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")
    spark = nav.sparkSession
    spark.sql("SELECT :text AS value", args={"text": json.dumps(parameters, ensure_ascii=False, sort_keys=True, default=str)}).write.mode("errorifexists").text(f"{path}/parameters")
