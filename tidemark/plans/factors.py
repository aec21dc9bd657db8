"""Price and fundamental factors: a registry of column builders over one panel.

A factor is a column of the panel's rows (date, symbol, close_hfq, ...). All price factors share one window per symbol,
so a whole factor panel costs one shuffle. Values use rows up to their own date only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.contracts import Watch, watch_unique
from tidemark.operators.dedupe import assert_unique

def _by() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def momentum(n: int, x: str = "close_hfq") -> Column:
    """x / x n sessions ago - 1."""
    return F.try_divide(F.col(x), F.lag(x, n).over(_by())) - 1


def moving_average(n: int, x: str = "close_hfq") -> Column:
    """Mean of the last n sessions, null unless all n have a value; of a panel with the rolled column."""
    return F.col(rolled_name("mean", n, x))


def trend_gap(n: int, x: str = "close_hfq") -> Column:
    return F.try_divide(F.col(x), moving_average(n, x)) - 1


def above_average(n: int, x: str = "close_hfq") -> Column:
    """1.0 if strictly above the moving average, else 0.0; null without one."""
    ma = moving_average(n, x)
    return F.when(ma.isNotNull(), (F.col(x) > ma).cast("double"))


def volatility(n: int, ret: str = "_return") -> Column:
    """Sample deviation of the last n simple returns, null unless all n are there; of a panel with the rolled column."""
    return F.col(rolled_name("deviation", n, ret))


def rolled_name(kind: str, n: int, x: str) -> str:
    return f"_{kind}_{n}_{x}"


def _joined(near: tuple[Column, Column], w: int, far: tuple[Column, Column], v: int) -> tuple[Column, Column]:
    """Mean and sum of squared distances from it, of w rows and v others."""
    d = far[0] - near[0]
    return near[0] + d * F.lit(v / (w + v)), near[1] + far[1] + d * d * F.lit(w * v / (w + v))


def rolled(panel: DataFrame, needs: Iterable[tuple[str, int, str]]) -> DataFrame:
    """panel with a column for each (kind, n, x): mean or sample deviation of x over the last n sessions of the symbol, null
    unless all n have a value.

    A frame that moves is summed anew for every row, n values each. Here sums of 1, 2, 4, ... rows are each made of two
    of the level before, and n rows are joined from the levels in n's binary digits: log2(n) lags a row, in windows that
    share one sort. Deviations are joined from means and squared distances, so nothing cancels out."""
    needs = sorted(set(needs))
    longest: dict[tuple[str, str], int] = {}
    for kind, n, x in needs:
        longest[kind, x] = max(n, longest.get((kind, x), 0))
    name = lambda kind, x, w, part="": f"_{kind}{part}_of_{w}_{x}"
    levels = {name(kind, x, 1): F.col(x).cast("double") for kind, x in longest}
    levels |= {name(kind, x, 1, "_squares"): F.col(x).cast("double") * 0 for kind, x in longest if kind == "deviation"}
    made, w = [*levels], 1
    panel = panel.withColumns(levels) if levels else panel

    def at(kind: str, x: str, w: int, back: int) -> tuple[Column, ...]:
        parts = ("", "_squares") if kind == "deviation" else ("",)
        return tuple(F.lag(name(kind, x, w, p), back).over(_by()) if back else F.col(name(kind, x, w, p)) for p in parts)

    while any(2 * w <= n for n in longest.values()):
        levels = {}
        for (kind, x), n in longest.items():
            if 2 * w > n:
                continue
            near, far = at(kind, x, w, 0), at(kind, x, w, w)
            both = _joined(near, w, far, w) if kind == "deviation" else (near[0] + far[0],)
            levels |= {name(kind, x, 2 * w, p): c for p, c in zip(("", "_squares"), both)}
        panel, w = panel.withColumns(levels), 2 * w
        made += levels
    out = {}
    for kind, n, x in needs:
        sizes = [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]
        whole, have = at(kind, x, sizes[0], 0), sizes[0]
        for v in sizes[1:]:
            part = at(kind, x, v, have)
            whole = _joined(whole, have, part, v) if kind == "deviation" else (whole[0] + part[0],)
            have += v
        out[rolled_name(kind, n, x)] = F.sqrt(whole[1] / F.lit(float(n - 1))) if kind == "deviation" else whole[0] / F.lit(float(n))
    return panel.withColumns(out).drop(*made) if out else panel


def positive(x: str) -> Column:
    return F.when(F.col(x) > 0, F.col(x))


def numeric(x: str) -> Column:
    return F.col(x).try_cast("double")


@dataclass(frozen=True)
class Factor:
    """``build(**parameters)`` gives the column; ``lookback(**parameters)`` how many sessions before it needs;
    ``rolling(**parameters)`` the columns of ``rolled`` that it is built from."""

    name: str
    build: Callable[..., Column]
    inputs: tuple[str, ...]
    higher_is_better: bool
    parameters: dict[str, int] = field(default_factory=dict)
    extra_sessions: int = 0
    version: str = "1"
    rolling: Callable[..., list[tuple[str, int, str]]] = lambda **_: []

    def resolved(self, given: dict[str, int] | None) -> dict[str, int]:
        if unknown := set(given or {}) - set(self.parameters):
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        out = self.parameters | (given or {})
        for k, v in out.items():
            if isinstance(v, bool) or not isinstance(v, int) or v < 1 or (k == "volatility_window" and v < 2):
                raise ValueError(f"{self.name}: {k} must be a positive whole number")
        return out

    def lookback(self, given: dict[str, int] | None = None) -> int:
        return max(self.resolved(given).values(), default=0) + self.extra_sessions


FACTORS = {
    f.name: f
    for f in (
        Factor("price_momentum_120d", lambda lookback_days: momentum(lookback_days), ("close_hfq",), True, {"lookback_days": 120}),
        Factor("price_trend_gap_120d", lambda trend_window: trend_gap(trend_window), ("close_hfq",), True, {"trend_window": 120}, rolling=lambda trend_window: [("mean", trend_window, "close_hfq")]),
        Factor("price_trend_above_ma_120d", lambda trend_window: above_average(trend_window), ("close_hfq",), True, {"trend_window": 120}, rolling=lambda trend_window: [("mean", trend_window, "close_hfq")]),
        Factor("price_volatility_60d", lambda volatility_window: volatility(volatility_window), ("close_hfq",), False, {"volatility_window": 60}, 1, rolling=lambda volatility_window: [("deviation", volatility_window, "_return")]),
        Factor("valuation_pe_ttm", lambda: positive("pe_ttm"), ("pe_ttm",), False),
        Factor("valuation_pb", lambda: positive("pb"), ("pb",), False),
        Factor("quality_roe_weighted", lambda: numeric("roe_weighted"), ("roe_weighted",), True),
        Factor("quality_operating_cashflow_ratio", lambda: numeric("operating_cashflow_to_revenue"), ("operating_cashflow_to_revenue",), True),
    )
}


def register(factor: Factor) -> None:
    if factor.name in FACTORS:
        raise ValueError(f"{factor.name} is registered already")
    FACTORS[factor.name] = factor


def requirements(names: Iterable[str], parameters: dict[str, dict] | None = None) -> tuple[list[str], int]:
    """The panel columns that factors need, and their longest look-back."""
    names = list(names)
    return sorted({c for n in names for c in FACTORS[n].inputs}), max((FACTORS[n].lookback((parameters or {}).get(n)) for n in names), default=0)


def check_panel(panel: DataFrame, names: Iterable[str], rows: bool = True) -> DataFrame:
    """Raise unless the panel has date, symbol and the factors' inputs, a date that is one, and (``rows``, a job of its
    own) unique keys that are not null."""
    if missing := {"date", "symbol", *requirements(names)[0]} - set(panel.columns):
        raise ValueError(f"the panel lacks {sorted(missing)}")
    if panel.schema["date"].dataType.simpleString() not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError("the panel's date is no date")
    return assert_unique(panel, ["date", "symbol"]) if rows else panel


def calculate(panel: DataFrame, names: Iterable[str], parameters: dict[str, dict] | None = None, check_rows: bool = False) -> DataFrame:
    """panel with ``listing_days`` (the session count of the symbol inside the panel) and a column for each factor. The
    panel's columns are checked; its rows with ``check_rows``, which costs a pass over it."""
    names = list(names)
    check_panel(panel, names, check_rows)
    rows = panel.withColumn("_return", F.try_divide(F.col("close_hfq"), F.lag("close_hfq").over(_by())) - 1) if "close_hfq" in panel.columns else panel
    given = {n: FACTORS[n].resolved((parameters or {}).get(n)) for n in names}
    needs = sorted({r for n in names for r in FACTORS[n].rolling(**given[n])})
    built = {n: FACTORS[n].build(**given[n]) for n in names}
    return rolled(rows, needs).withColumns({"listing_days": F.row_number().over(_by()), **built}).drop("_return", *(rolled_name(*r) for r in needs))


def calculate_watched(panel: DataFrame, names: Iterable[str], parameters: dict[str, dict] | None = None) -> tuple[DataFrame, Watch]:
    """``calculate``, and the watch over the panel's keys: what ``check_rows`` finds by a job of its own, found while the
    factors are computed, in the windows that they share."""
    names = list(names)
    rows, watched = watch_unique(check_panel(panel, names, False), "symbol", "date")
    return calculate(rows, names, parameters), watched


def calculate_sliced(panel: DataFrame, names: Iterable[str], length: int = 2048, parameters: dict[str, dict] | None = None) -> DataFrame:
    """``calculate`` for symbols too long for one task: equal to it, whatever ``length`` (sessions in a slice).

    A symbol's rows are cut at the same dates as all others', and each slice gets the rows before it that its look-backs
    reach: the last ones of the slices before, as many as the longest look-back asks for, however far back gaps in the
    symbol's dates push them. Only counts by symbol and slice are ever gathered over a whole symbol. With slices longer
    than the look-back hardly any row is copied more than once."""
    names = list(names)
    lookback = requirements(names, parameters)[1]
    check_panel(panel, names, False)
    days = panel.select("date").distinct().withColumn("_slice", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / length).cast("int"))
    w = Window.partitionBy("symbol", "_slice")
    rows = panel.join(F.broadcast(days), "date")
    sizes = rows.groupBy("symbol", "_slice").agg(F.count("*").alias("n"))
    order = Window.partitionBy("symbol").orderBy("_slice")
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a later slice needs the last rows of this one if fewer than the look-back lie in between
    ahead = F.filter(F.collect_list(F.struct(F.col("_slice").alias("of"), F.col("before").alias("start"))).over(order.rowsBetween(1, max(1, lookback))), lambda x: x["start"] - F.col("before") - F.col("n") < lookback)
    sizes = sizes.withColumn("ahead", F.transform(ahead, lambda x: F.struct(x["of"].alias("of"), (lookback - (x["start"] - F.col("before") - F.col("n"))).alias("need"), x["start"].alias("start")))).drop("n")
    placed = rows.withColumn("_last", F.row_number().over(w.orderBy(F.desc("date")))).join(sizes, ["symbol", "_slice"])
    own = F.array(F.struct(F.col("_slice").alias("of"), F.col("_last").cast("long").alias("need"), F.col("before").alias("start")))
    needed = F.filter("ahead", lambda x: F.col("_last") <= x["need"])
    copies = placed.withColumn("_to", F.explode(F.concat(own, needed)))
    keyed = copies.select(F.struct("symbol", F.col("_to.of").alias("slice")).alias("symbol"), (F.col("_to.of") == F.col("_slice")).alias("_own"), F.col("_to.start").alias("_start"), *(c for c in panel.columns if c != "symbol"))
    made = calculate(keyed, names, parameters).filter("_own")
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))  # inside the slice
    return made.withColumn("listing_days", (first + F.col("_start")).cast("int")).select("symbol.symbol", *(c for c in [*panel.columns, "listing_days", *names] if c != "symbol")).select(*panel.columns, "listing_days", *names)


def check_result(result: DataFrame, name: str) -> DataFrame:
    """(date, symbol, value) of a factor's result, values that are no number as null, after a check: the three columns,
    dates that are dates, and unique keys that are not null."""
    if missing := {"date", "symbol", "value"} - set(result.columns):
        raise ValueError(f"the result of {name} lacks {sorted(missing)}")
    out = result.select(F.col("date").try_cast("date").alias("date"), "symbol", F.col("value").try_cast("double").alias("value"))
    return assert_unique(out, ["date", "symbol"])


def long_form(panel: DataFrame, name: str, check_rows: bool = False) -> DataFrame:
    """(date, symbol, value) of one factor; ``check_rows``: by the contract of a factor's result."""
    out = panel.select("date", "symbol", F.col(name).alias("value"))
    return check_result(out, name) if check_rows else out
