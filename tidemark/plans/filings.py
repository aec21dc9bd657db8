"""Filing dates: reconciliation over sources, overdue filings, official announcements.

``filings``: source, symbol, report_date, publish_date, available_date (texts) and value columns; one table for all
sources and symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D

PERIOD = ["symbol", "report_date"]


def canonical_dates(filings: DataFrame) -> DataFrame:
    """(symbol, report_date, publish, available): the earliest publish date over the sources, and the latest of all
    publish and available dates, from which on the period is safe to use; periods without any date have nulls."""
    p, a = D.normalize_date(F.col("publish_date")), D.normalize_date(F.col("available_date"))
    return filings.groupBy(*PERIOD).agg(F.min(p).alias("publish"), F.max(F.greatest(p, a)).alias("available"))


def reconcile(filings: DataFrame) -> DataFrame:
    """filings with the canonical dates in every source and ``changed``: whether a row had other texts. A period without
    any date keeps its texts. Needs one shuffle: the minima are windows over the period."""
    w = Window.partitionBy(*PERIOD)
    p, a = D.normalize_date(F.col("publish_date")), D.normalize_date(F.col("available_date"))
    out = filings.withColumns({"_p": F.coalesce(F.min(p).over(w), F.col("publish_date")), "_a": F.coalesce(F.max(F.greatest(p, a)).over(w), F.col("available_date"))})
    changed = ~(F.col("_p").eqNullSafe(F.col("publish_date")) & F.col("_a").eqNullSafe(F.col("available_date")))
    return out.withColumn("changed", changed).withColumns({"publish_date": F.col("_p"), "available_date": F.col("_a")}).drop("_p", "_a")


def changed_rows(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("source").agg(F.count_if("changed").alias("changed"), F.count("*").alias("rows"))


def overdue(filings: DataFrame, today: Column) -> DataFrame:
    """(symbol, report_date, publish, deadline) of periods published after the statutory deadline, up to today."""
    out = canonical_dates(filings).select(*PERIOD, D.as_date(F.col("publish")).alias("publish"), D.deadline(F.col("report_date")).alias("deadline"))
    return out.filter((F.col("publish") > F.col("deadline")) & (F.col("publish") <= today))


def search_window(overdue: DataFrame, end: Column) -> DataFrame:
    """(symbol, first, last): where a symbol's announcements are looked for: from its earliest overdue period's end to
    the later of ``end`` and its latest deadline."""
    return overdue.groupBy("symbol").agg(F.min(D.as_date(F.col("report_date"))).alias("first"), F.greatest(F.max("deadline"), F.max(end)).alias("last"))


def first_disclosures(periods: DataFrame, announcements: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """(symbol, report_date, official, title, url): each period's earliest announcement that is its report, ties by
    title and url. An equi-join on the symbol with the title test as its residual, minimum first in each task."""
    if window is not None:
        announcements = announcements.join(window, "symbol").filter("publish_date BETWEEN first AND last")
    met = periods.select(*PERIOD).distinct().join(announcements.select("symbol", "publish_date", "title", "url"), "symbol")
    met = met.filter(F.col("publish_date").isNotNull() & D.title_matches(F.col("title"), F.col("report_date")))
    first = F.min(F.struct(F.col("publish_date").alias("official"), "title", "url"))
    return met.groupBy(*PERIOD).agg(first.alias("m")).select(*PERIOD, "m.*")


def unresolved(overdue: DataFrame, official: DataFrame) -> DataFrame:
    """Overdue periods without an official disclosure."""
    return overdue.join(official.select(*PERIOD), PERIOD, "left_anti")


def apply_official(filings: DataFrame, official: DataFrame) -> DataFrame:
    """filings with official dates: they replace the publish date in every source, and the available date becomes the
    later of the two; other values stay. ``changed`` tells which rows differ."""
    text = F.date_format("official", "yyyyMMdd")
    met = filings.join(official.select(*PERIOD, "official"), PERIOD, "left")
    p = F.coalesce(text, F.col("publish_date"))
    a = F.when(text.isNotNull(), F.greatest(D.normalize_date(F.col("available_date")), text)).otherwise(F.col("available_date"))
    changed = ~(p.eqNullSafe(F.col("publish_date")) & a.eqNullSafe(F.col("available_date")))
    return met.select(*(c for c in filings.columns if c not in ("publish_date", "available_date")), p.alias("publish_date"), a.alias("available_date"), changed.alias("changed"))


def complete_periods(filings: DataFrame, sources: tuple[str, ...] = ("balance", "income", "cashflow")) -> DataFrame:
    """Periods that all of the sources have."""
    return filings.filter(F.col("source").isin(*sources)).groupBy(*PERIOD).agg(F.countDistinct("source").alias("n")).filter(F.col("n") == len(sources)).select(*PERIOD)


def missing_symbols(universe: DataFrame, filings: DataFrame, sources: tuple[str, ...] = ("balance", "income", "cashflow", "indicator")) -> DataFrame:
    """(symbol, source) of universe symbols without any row in a source."""
    wanted = universe.select("symbol").distinct().withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    return wanted.join(filings.select("symbol", "source").distinct(), ["symbol", "source"], "left_anti")
