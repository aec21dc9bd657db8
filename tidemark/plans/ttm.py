"""Trailing-twelve-month figures and the planning of their recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.dedupe import first_by
from tidemark.operators.storage import cut
from tidemark.plans.planning import SyncState
from tidemark.sources.store import Layout, Store

#: Metric: its source.
METRICS = {"net_profit": "income", "revenue": "income", "ocf": "cashflow", "deduct_net_profit": "indicator"}
COLUMNS = [f"{m}_ttm" for m in ("net_profit", "deduct_net_profit", "revenue", "ocf")]


def current_revisions(filings: DataFrame) -> DataFrame:
    """One row per (source, symbol, report_date): the one published last, nulls first, ties by its values; all metrics of
    a source come from the same revision. Rows without a valid report period are left out."""
    rows = filings.withColumns({"report_date": D.normalize_date(F.col("report_date")), "pub_date": D.normalize_date(F.col("publish_date"))}).filter("report_date IS NOT NULL")
    return first_by(rows, ["source", "symbol", "report_date"], F.desc_nulls_last("pub_date"))


def ttm(filings: DataFrame) -> DataFrame:
    """(symbol, report_date, pub_date, *_ttm): current + (last year end - last year's same period) by metric, null if an
    operand is; periods without any figure are left out. pub_date is the latest publish date of the current period over
    the sources. The sources meet in one aggregation, which is their full outer join, and the two periods of last year in
    frames over the symbol's periods, so filings are read and shuffled once."""
    rows = current_revisions(filings.filter(F.col("source").isin(*set(METRICS.values()))).repartition("symbol"))
    own = [F.max(F.when(F.col("source") == s, F.col(m))).alias(m) for m, s in METRICS.items()]
    cur = rows.groupBy("symbol", "report_date").agg(F.max("pub_date").alias("pub_date"), *own)
    day, year, by = F.col("report_date").cast("int"), F.substring("report_date", 1, 4).cast("int"), Window.partitionBy("symbol")
    same = by.orderBy(day).rangeBetween(-10_000, -10_000)  # YYYYMMDD a year ago
    before = by.orderBy(year).rangeBetween(-1, -1)
    known = lambda c: F.when(F.col("symbol").isNotNull(), c)
    end = lambda m: F.max(F.when(D.month_day(F.col("report_date")) == "1231", F.col(m))).over(before)
    met = cur.withColumns({f"s_{m}": known(F.max(m).over(same)) for m in METRICS} | {f"e_{m}": known(end(m)) for m in METRICS})
    out = met.select("symbol", "report_date", "pub_date", *(F.expr(f"{c[:-4]} + (e_{c[:-4]} - s_{c[:-4]})").alias(c) for c in COLUMNS))
    return out.dropna("all", subset=COLUMNS)


def work_plan(filings: DataFrame, done: DataFrame, pending: DataFrame | None = None, force: bool = False, quarters: int = 5, source: str = "income") -> DataFrame:
    """(symbol, last_period, reason): whose figures are to be computed. ``pending``: named so, whatever they have filed;
    ``stale``: with a later period in ``source`` than in their figures, and the last ``quarters`` consecutive periods in
    it; ``force``: all. Symbols without a filing in ``source`` are never in it."""
    rows = filings.filter(F.col("source") == source).select("symbol", "report_date")
    plan = rows.groupBy("symbol").agg(F.max("report_date").alias("last_period"))
    if force:
        return plan.withColumn("reason", F.lit("forced"))
    plan = plan.join(done.groupBy("symbol").agg(F.max("report_date").alias("done_period")), "symbol", "left")
    reason = F.when(F.col("done_period").isNull() | (F.col("last_period") > F.col("done_period")), "stale")
    if pending is not None:
        plan = plan.join(pending.select("symbol", F.lit(True).alias("_pending")).distinct(), "symbol", "left")
        reason = F.when(F.col("_pending"), "pending").otherwise(reason)
    plan = plan.withColumn("reason", reason).filter("reason IS NOT NULL").select("symbol", "last_period", "reason")
    need = plan.filter("reason = 'stale'").withColumn("report_date", F.explode(D.quarters_back(F.col("last_period"), quarters)))
    whole = need.join(rows.distinct(), ["symbol", "report_date"]).groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") == quarters)
    return plan.filter("reason = 'pending'").unionByName(plan.filter("reason = 'stale'").join(whole.select("symbol"), "symbol", "left_semi"))


#: The state's name for symbols whose figures are to be computed.
PENDING = "ttm_pending"
FILINGS = Layout(
    "source STRING, symbol STRING, report_date STRING, publish_date STRING, available_date STRING, revenue DOUBLE, net_profit DOUBLE, deduct_net_profit DOUBLE, ocf DOUBLE, net_assets DOUBLE, roe_weighted DOUBLE, operating_cashflow_to_revenue DOUBLE",
    ("source", "symbol", "report_date"), folders=("source",), together=("source",),
)
FIGURES = Layout("symbol STRING, report_date STRING, pub_date STRING, net_profit_ttm DOUBLE, deduct_net_profit_ttm DOUBLE, revenue_ttm DOUBLE, ocf_ttm DOUBLE", ("symbol", "report_date"))


def refresh(filings: Store, figures: Store, plan: DataFrame) -> int:
    """Compute the figures of the symbols in ``plan`` (``work_plan``'s rows, or any with a symbol) anew and put them in place
    of the stored ones. Only the buckets of those symbols are read and written; gives the number of folders written."""
    plan = cut(plan.select("symbol").distinct())
    return figures.replace(ttm(filings.of(plan)), plan)


def run(filings: Store, figures: Store, state: SyncState, force: bool = False, quarters: int = 5) -> DataFrame:
    """Plan from what is stored and from the symbols that the state has as pending, compute those anew, and clear them from
    the state; the plan comes back. The state is cleared last: a run that fails in between is done again."""
    plan = cut(work_plan(filings.read(), figures.read(), state.known(PENDING), force, quarters))
    refresh(filings, figures, plan)
    state.clear(PENDING, plan)
    return plan
