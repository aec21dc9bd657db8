"""Performance metrics of value series, for all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.market import number, percent


def performance(nav: DataFrame, column: str = "nav", by: str = "run_id") -> DataFrame:
    """(by, total_return, annualized_return, annualized_volatility, sharpe_ratio, max_drawdown, trading_days) of the non-null
    values of a series; a series without values has null metrics and 0 days."""
    x, w = F.col(column), Window.partitionBy(by).orderBy("date")
    rows = nav.filter(x.isNotNull()).select(by, "date", x.alias("x")).withColumns({"r": F.try_divide(F.col("x"), F.lag("x").over(w)) - 1, "d": F.col("x") / F.max("x").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    out = rows.groupBy(by).agg(
        (F.max_by("x", "date") / F.min_by("x", "date") - 1).alias("total_return"),
        F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)).alias("days"),
        F.stddev_pop("r").alias("sd"), F.avg("r").alias("mean"), F.count("r").alias("returns"), F.min("d").alias("max_drawdown"), F.count("*").alias("trading_days"),
    )
    year = F.sqrt(F.lit(252.0))
    out = out.select(by, "total_return", (F.pow(1 + F.col("total_return"), 365.25 / F.col("days")) - 1).alias("annualized_return"), F.coalesce(F.col("sd") * year, F.lit(0.0)).alias("annualized_volatility"), F.when((F.col("returns") > 1) & (F.col("sd") > 0), F.col("mean") / F.col("sd") * year).alias("sharpe_ratio"), "max_drawdown", "trading_days")
    return nav.select(by).distinct().join(out, by, "left").withColumn("trading_days", F.coalesce("trading_days", F.lit(0)))


def turnover(nav: DataFrame, trades: DataFrame) -> DataFrame:
    """(run_id, turnover, trade_count): traded value (BUY and SELL) over the first value, and the number of all rows of
    the ledger."""
    first = nav.groupBy("run_id").agg(F.min_by("nav", "date").alias("first"))
    deal = F.col("side").isin("BUY", "SELL")
    sums = trades.groupBy("run_id").agg(F.sum(F.when(deal, F.col("notional")).otherwise(0.0)).alias("v"), F.count("*").alias("trade_count"))
    return first.join(sums, "run_id", "left").select("run_id", (F.coalesce("v", F.lit(0.0)) / F.col("first")).alias("turnover"), F.coalesce("trade_count", F.lit(0)).alias("trade_count"))


def summary_table(strategy: DataFrame, benchmark: DataFrame, turned: DataFrame | None = None) -> DataFrame:
    """(run_id, line, text): a Markdown table of the metrics of strategy and benchmark, both by run_id, and below it
    turnover and trade count (``turned``, by run_id)."""
    rows = {"total_return": percent, "annualized_return": percent, "annualized_volatility": percent, "sharpe_ratio": number, "max_drawdown": percent, "trading_days": lambda c: c.cast("string")}
    met = strategy.alias("s").join(benchmark.alias("b"), "run_id", "left")
    met = met.join(turned.alias("t"), "run_id", "left") if turned is not None else met
    cell = lambda c: F.coalesce(c, F.lit("—"))
    lines = [F.lit("| metric | strategy | benchmark |"), F.lit("|---|---:|---:|"), *(F.concat(F.lit(f"| {k} | "), cell(show(F.col(f"s.{k}"))), F.lit(" | "), cell(show(F.col(f"b.{k}"))), F.lit(" |")) for k, show in rows.items())]
    if turned is not None:
        lines += [F.lit(""), F.concat(F.lit("turnover (traded value over the first value): "), number(F.col("t.turnover"))), F.concat(F.lit("trades: "), cell(F.col("t.trade_count").cast("string")))]
    return met.select("run_id", F.posexplode(F.array(*lines)).alias("line", "text"))
