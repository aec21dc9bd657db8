"""Monthly target portfolios from factor panels."""

from __future__ import annotations

from collections.abc import Callable
from math import isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import cross_section as X
from tidemark.operators.contracts import Watch, watch
from tidemark.operators.storage import cut
from tidemark.plans import factors

#: Default weights of the multi-factor score. Fixed values.
WEIGHTS = {"price_momentum_120d": 0.20, "price_trend_gap_120d": 0.15, "price_volatility_60d": 0.10, "valuation_pe_ttm": 0.15, "valuation_pb": 0.15, "quality_roe_weighted": 0.125, "quality_operating_cashflow_ratio": 0.125}


def month_ends(df: DataFrame) -> DataFrame:
    """The last date of each month that df has; a month cut short counts as well."""
    return df.groupBy(F.trunc("date", "month").alias("_month")).agg(F.max("date").alias("date")).select("date")


def equal_weight(candidates: DataFrame, holding_count: int) -> DataFrame:
    """(date, symbol, score, rank, target_weight) of the first ``holding_count`` ranks of each date, at 1/n each."""
    chosen = candidates.filter(F.col("rank") <= holding_count).select("date", "symbol", "score", "rank")
    return chosen.withColumn("target_weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("date")))


def check_targets(targets: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """targets, in order, after a check: dates and symbols that are not null, symbols unique and weights positive and at
    most 1.000001 in all by ``by``."""
    sums = targets.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.sum("target_weight").alias("total"), F.count_if(F.coalesce(F.col("target_weight") <= 0, F.lit(True))).alias("bad"))
    if row := sums.filter(" OR ".join([*(f"{c} IS NULL" for c in by), "n != symbols", "bad > 0", "total > 1.000001"])).take(1):
        raise ValueError(f"targets of {row[0]['date']} are not valid")
    return targets.orderBy(*by, *(c for c in ("rank", "symbol") if c in targets.columns))


def watch_targets(targets: DataFrame, by: tuple[str, ...] = ("date",)) -> tuple[DataFrame, Watch]:
    """The contract of ``check_targets``, checked while an action writes or reads the targets."""
    w = Window.partitionBy(*by)
    again = F.row_number().over(w.orderBy("symbol")) > 1
    again &= F.lag("symbol").over(w.orderBy("symbol")).eqNullSafe(F.col("symbol"))
    marked = targets.withColumns({"_again": again, "_total": F.sum("target_weight").over(w)})
    bad = F.col("_again") | F.col("symbol").isNull() | F.coalesce(F.col("target_weight") <= 0, F.lit(True)) | (F.col("_total") > 1.000001)
    for c in by:
        bad |= F.col(c).isNull()
    out, watched = watch(marked, bad, ["date"], "targets of {0} are not valid")
    return out.drop("_again", "_total"), watched


def _whole(name: str, value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive whole number")
    return value


def _number(name: str, value: object, low: float = float("-inf"), high: float = float("inf")) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not isfinite(value) or not low <= value <= high:
        raise ValueError(f"{name} must be a number from {low} to {high}")
    return float(value)


def resolve(defaults: dict, given: dict | None) -> dict:
    if unknown := set(given or {}) - set(defaults):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    out = defaults | (given or {})
    for k, v in out.items():
        if k in ("holding_count", "lookback_days", "trend_window", "min_listing_days"):
            _whole(k, v)
        elif k in ("pe_pb_percentile", "winsorize_lower", "winsorize_upper"):
            _number(k, v, 0, 1)
        elif k != "factor_weights":
            _number(k, v)
    return out


def normalized_weights(given: dict[str, float] | None) -> dict[str, float]:
    """Default weights with the given ones in their place, summing to 1; none may be negative, nor all zero."""
    if unknown := set(given or {}) - set(WEIGHTS):
        raise ValueError(f"no such factor in the score: {sorted(unknown)}")
    merged = {k: _number(k, v, 0) for k, v in (WEIGHTS | (given or {})).items()}
    if not (total := sum(merged.values())):
        raise ValueError("the weights are all zero")
    return {k: v / total for k, v in merged.items()}


def _signals(panel: DataFrame, names: list[str], start: str, listing_days: int, parameters: dict | None = None) -> DataFrame:
    """(date, symbol, listing_days, and the factors) of the month ends from start on with enough sessions.

    The panel is computed once: in the windows of the factors each symbol's last row of a month is found, and only those
    are written; the dates that all symbols' last ones reach are the month ends."""
    rows = factors.calculate(panel, names, parameters)
    after = F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))
    rows = rows.withColumn("_last", ~F.trunc(after, "month").eqNullSafe(F.trunc("date", "month")))
    rows = cut(rows.filter((F.col("date") >= F.lit(start).cast("date")) & F.col("_last")).select("date", "symbol", "listing_days", *names))
    return rows.join(F.broadcast(month_ends(rows)), "date", "left_semi").filter(F.col("listing_days") >= listing_days)


def momentum_targets(panel: DataFrame, start: str, parameters: dict | None = None) -> DataFrame:
    """Highest momentum among symbols above their moving average."""
    p = resolve({"holding_count": 20, "lookback_days": 120, "trend_window": 120, "min_listing_days": 250}, parameters)
    names = ["price_momentum_120d", "price_trend_above_ma_120d"]
    rows = _signals(panel, names, start, p["min_listing_days"], {names[0]: {"lookback_days": p["lookback_days"]}, names[1]: {"trend_window": p["trend_window"]}})
    rows = rows.filter(F.col(names[0]).isNotNull() & (F.col(names[1]) > 0)).withColumn("score", F.col(names[0]))
    return equal_weight(rows.withColumn("rank", X.place("score")), p["holding_count"])


def quality_value_targets(panel: DataFrame, start: str, parameters: dict | None = None) -> DataFrame:
    """Lowest PE and PB ranks among profitable symbols above their moving average."""
    p = resolve({"holding_count": 20, "pe_pb_percentile": 0.4, "min_roe": 8.0, "min_operating_cashflow_to_revenue": 0.0, "trend_window": 120, "min_listing_days": 250}, parameters)
    names = ["valuation_pe_ttm", "valuation_pb", "quality_roe_weighted", "quality_operating_cashflow_ratio", "price_trend_above_ma_120d"]
    rows = _signals(panel, names, start, p["min_listing_days"], {names[4]: {"trend_window": p["trend_window"]}})
    rows = rows.filter(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull() & (F.col(names[2]) > p["min_roe"]) & (F.col(names[3]) > p["min_operating_cashflow_to_revenue"]) & (F.col(names[4]) > 0))
    rows = rows.withColumns({"pe_percentile": X.pct_rank(names[0]), "pb_percentile": X.pct_rank(names[1])})
    rows = rows.filter((F.col("pe_percentile") <= p["pe_pb_percentile"]) & (F.col("pb_percentile") <= p["pe_pb_percentile"]))
    rows = rows.withColumn("score", F.col("pe_percentile") + F.col("pb_percentile"))
    return equal_weight(rows.withColumn("rank", X.place("score", ascending=True)), p["holding_count"])


def multi_factor_targets(panel: DataFrame, start: str, parameters: dict | None = None) -> DataFrame:
    """Highest weighted sum of the factors' ranks, winsorized by date, each in its better direction."""
    p = resolve({"holding_count": 20, "min_listing_days": 250, "winsorize_lower": 0.05, "winsorize_upper": 0.95, "factor_weights": None}, parameters)
    if p["winsorize_lower"] >= p["winsorize_upper"]:
        raise ValueError("winsorize_lower must be below winsorize_upper")
    weights = normalized_weights(p["factor_weights"])
    rows = _signals(panel, list(weights), start, p["min_listing_days"]).dropna(subset=list(weights))
    rows = X.winsorized(rows, list(weights), p["winsorize_lower"], p["winsorize_upper"])
    rows = rows.withColumns({f"{n}_rank": X.pct_rank(n, factors.FACTORS[n].higher_is_better) for n in weights})
    rows = rows.withColumn("score", X.combine({f"{n}_rank": w for n, w in weights.items()}))
    return equal_weight(rows.withColumn("rank", X.place("score")), p["holding_count"])


Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {"price-momentum": momentum_targets, "quality-value-recovery": quality_value_targets, "multi-factor-quality-value-momentum": multi_factor_targets}


