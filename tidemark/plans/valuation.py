"""Daily valuation and the market panel, aligned as of each day without look-ahead."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.asof import Right, asof_join
from tidemark.operators.dedupe import first_by
from tidemark.plans import factors

EXTRA = ("high", "low", "volume", "amount")


def ttm_side(ttm: DataFrame, how: str = "inner") -> Right:
    """TTM rows by publish date; of several on a day the latest period."""
    rows = ttm.withColumn("eff", D.as_date(F.col("pub_date"))).filter("eff IS NOT NULL")
    cols = ["net_profit_ttm", "deduct_net_profit_ttm", "revenue_ttm", "ocf_ttm"]
    return Right(first_by(rows.select("symbol", "eff", "report_date", *cols), ["symbol", "eff"], F.desc("report_date")), "eff", cols, how)


def net_assets_side(filings: DataFrame, how: str = "inner") -> Right:
    rows = filings.filter("source = 'balance'").withColumn("eff", D.effective_date(F.col("available_date"), F.col("publish_date"))).filter("eff IS NOT NULL")
    return Right(first_by(rows.select("symbol", "eff", "report_date", "net_assets"), ["symbol", "eff"], F.desc("report_date")), "eff", ["net_assets"], how)


def indicator_side(filings: DataFrame, how: str = "left") -> Right:
    cols = ["roe_weighted", "operating_cashflow_to_revenue"]
    rows = filings.filter("source = 'indicator'").withColumn("eff", D.effective_date(F.col("available_date"), F.col("publish_date"))).filter("eff IS NOT NULL")
    return Right(first_by(rows.select("symbol", "eff", "report_date", *cols), ["symbol", "eff"], F.desc("report_date")), "eff", cols, how)


def daily_valuation(bars: DataFrame, capital: DataFrame, ttm: DataFrame, filings: DataFrame, how: str = "inner", more: tuple[str, ...] = (), also: tuple[Right, ...] = ()) -> DataFrame:
    """(date, symbol, raw_close, close_hfq, total_shares, market_cap, pe_ttm, pe_deduct_ttm, pb, ps_ttm, pcf_ttm, ...):
    bars with the share capital, TTM and net assets known on the day; a bar before any of them goes (``how``: inner) or
    has nulls (left). Ratios with a zero denominator are null, negative ones stay. ``also``: further right sides, whose
    columns come last; all sides share one shuffle."""
    return valued(bars, Right(capital.select("symbol", "change_date", "total_shares"), "change_date", ["total_shares"], how), ttm_side(ttm, how), net_assets_side(filings, how), more=more, also=also)


def valued(bars: DataFrame, capital: Right, ttm: Right, equity: Right, more: tuple[str, ...] = (), also: tuple[Right, ...] = ()) -> DataFrame:
    """``daily_valuation`` of right sides that are made already."""
    met = asof_join(bars.select("symbol", "date", "close", "adj_factor", *more), capital, ttm, equity, *also)
    cap = F.col("close") * F.col("total_shares")
    ratio = lambda c: cap / F.nullif(F.col(c), F.lit(0.0))
    return met.select(
        "date", "symbol", F.col("close").alias("raw_close"), (F.col("close") * F.col("adj_factor")).alias("close_hfq"), "total_shares", cap.alias("market_cap"),
        ratio("net_profit_ttm").alias("pe_ttm"), ratio("deduct_net_profit_ttm").alias("pe_deduct_ttm"), ratio("net_assets").alias("pb"), ratio("revenue_ttm").alias("ps_ttm"), ratio("ocf_ttm").alias("pcf_ttm"), *more, *(c for r in also for c in r.columns),
    )


def lookback_start(bars: DataFrame, start: str, sessions: int):
    """The earliest of the last ``sessions`` session dates before ``start``, fewer being enough; none raises."""
    first = bars.select("date").filter(F.col("date") < F.lit(start).cast("date")).distinct().orderBy(F.desc("date")).limit(sessions).agg(F.min("date").alias("d")).first()["d"]
    if first is None:
        raise ValueError(f"no session before {start}")
    return first


def market_panel(bars: DataFrame, capital: DataFrame, ttm: DataFrame, filings: DataFrame, start: str, end: str, lookback: int = 0, extra: tuple[str, ...] = (), indicators: bool = True) -> DataFrame:
    """The valuation between ``start``, less ``lookback`` sessions, and ``end``, with open, open_hfq, the bar columns in
    ``extra`` and the indicators known on the day (nulls if none). Bars are cut at both ends before the as-of joins;
    their right sides keep all that came before."""
    if unknown := set(extra) - set(EXTRA):
        raise ValueError(f"unknown bar columns {sorted(unknown)}")
    low = lookback_start(bars, start, lookback) if lookback else start
    within = bars.filter(F.col("date").between(F.lit(low).cast("date"), F.lit(end).cast("date")))
    out = daily_valuation(within, capital, ttm, filings, more=("open", *extra), also=(indicator_side(filings),) if indicators else ())
    return out.withColumn("open_hfq", F.try_divide(F.col("open") * F.col("close_hfq"), F.col("raw_close")))


def panel_for(bars: DataFrame, capital: DataFrame, ttm: DataFrame, filings: DataFrame, start: str, end: str, names: Iterable[str], parameters: dict[str, dict] | None = None, sessions: int = 0) -> DataFrame:
    """The market panel that factors need: their inputs decide which bar columns and whether indicators are joined, and
    the longest look-back, or ``sessions`` if that is more, how far before ``start`` it begins."""
    inputs, lookback = factors.requirements(names, parameters)
    known = {"date", "symbol", "raw_close", "close_hfq", "total_shares", "market_cap", "pe_ttm", "pe_deduct_ttm", "pb", "ps_ttm", "pcf_ttm", "open", "open_hfq"}
    indicators = {"roe_weighted", "operating_cashflow_to_revenue"}
    if unknown := set(inputs) - known - indicators - set(EXTRA):
        raise ValueError(f"no panel has the columns {sorted(unknown)}")
    return market_panel(bars, capital, ttm, filings, start, end, max(lookback, sessions), tuple(c for c in EXTRA if c in inputs), bool(indicators & set(inputs)))
