"""Portfolio evaluation of target tables, for all runs, days and symbols at once.

Targets of a signal date are executed at the next session's open. Between two executions a holding's value is its weight
times a ratio of prices, and every drift weight, turnover and cost is independent of the level of the portfolio, so the
days need no loop: the value is the start capital times a product over the executed plans. Only which plans are executed
is sequential (a plan is skipped while a held symbol has no valid open); that takes a logarithmic number of rounds.

prices: date, symbol, open, open_hfq, close_hfq, unique by (date, symbol); a row with a valid open has a close.
targets: run_id, date, symbol, target_weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import Right, asof_join
from tidemark.operators.contracts import Watch, watch
from tidemark.operators.dedupe import first_by
from tidemark.operators.storage import cut, forget
from tidemark.plans.strategies import watch_targets


@dataclass(frozen=True)
class Config:
    """Evaluation period, start capital, and costs in basis points of traded value."""

    start: str
    end: str
    capital: float = 1_000_000.0
    commission_bps: float = 3.0
    slippage_bps: float = 5.0

    def __post_init__(self) -> None:
        if self.start > self.end or self.capital <= 0 or min(self.commission_bps, self.slippage_bps) < 0:
            raise ValueError("start must not be after end, capital must be positive, costs not negative")

    @property
    def rate(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 10_000


def within(prices: DataFrame, config: Config) -> DataFrame:
    return prices.filter(F.col("date").between(F.lit(config.start).cast("date"), F.lit(config.end).cast("date")))


def sessions(prices: DataFrame, config: Config) -> DataFrame:
    """(date, next, number): the sessions of the period, the one after each, and their numbers from 1. One window over a
    few thousand dates."""
    days = within(prices, config).select("date").distinct()
    w = Window.orderBy("date")
    return days.withColumns({"next": F.lead("date").over(w), "number": F.row_number().over(w)})


def plans(targets: DataFrame, days: DataFrame) -> DataFrame:
    """(run_id, signal_date, exec_date): each signal at the first session after it; of two signals for a session the later
    counts, and signals from the last session on have none. days is a small table, and so are the distinct dates."""
    signals = targets.select("run_id", F.col("date").alias("signal_date")).distinct()
    dates = signals.select(F.col("signal_date").alias("date"), F.lit(None).cast("date").alias("open")).distinct().union(days.select("date", F.col("date").alias("open")))
    after = F.min("open").over(Window.orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(1, Window.unboundedFollowing))
    met = dates.withColumn("exec_date", after).filter("open IS NULL AND exec_date IS NOT NULL").select(F.col("date").alias("signal_date"), "exec_date")
    return first_by(signals.join(met, "signal_date").select("run_id", "signal_date", "exec_date"), ["run_id", "exec_date"], F.desc("signal_date"))


def weights(targets: DataFrame, plan: DataFrame, prices: DataFrame) -> DataFrame:
    """(run_id, exec_date, signal_date, symbol, w, open, open_hfq) of targets that have an open on their session; the
    others' weight stays cash."""
    at = prices.select(F.col("date").alias("exec_date"), "symbol", "open", "open_hfq").filter("open_hfq IS NOT NULL")
    t = targets.select("run_id", F.col("date").alias("signal_date"), "symbol", F.col("target_weight").alias("w"))
    return t.join(plan, ["run_id", "signal_date"]).join(at, ["exec_date", "symbol"]).select("run_id", "exec_date", "signal_date", "symbol", "w", "open", "open_hfq")


def blocking_spans(plan: DataFrame, held: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """(run_id, n, symbol, a, b): the plans numbered a to b, all after plan n, that a symbol held since n would block, as it
    has no valid open on their sessions. plan: with k (its session's number) and n. A symbol whose quotes have ended is
    cash by then and blocks nothing.

    Only symbols that are held matter. Their gaps, the runs of sessions between two valid opens (or after the last, up
    to the last quote), become ranges of plans by each run's count of plans up to a session; no session is expanded."""
    at = days.select("date", F.col("number").alias("k"))
    owned = held.filter("w > 0").select("run_id", "exec_date", "symbol")
    prices = prices.join(owned.select("symbol").distinct(), "symbol", "left_semi")
    last = prices.groupBy("symbol").agg(F.max("date").alias("date")).join(at, "date").select("symbol", F.col("k").alias("last"))
    opens = prices.filter("open_hfq IS NOT NULL AND open_hfq != 0").select("symbol", "date").join(at, "date")
    opens = opens.select("symbol", "k").union(last.select("symbol", F.lit(0)))  # the gap before its first one
    gaps = opens.withColumn("to", F.lead("k").over(Window.partitionBy("symbol").orderBy("k"))).join(last, "symbol")
    gaps = gaps.select("symbol", F.col("k").alias("before"), F.coalesce(F.col("to") - 1, F.col("last")).alias("to")).filter("before < to")
    end = days.agg(F.max("number").alias("end")).first()["end"]
    grid = plan.select("run_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(end)))).join(plan.select("run_id", "k", "n"), ["run_id", "k"], "left")
    upto = grid.select("run_id", "k", F.coalesce(F.max("n").over(Window.partitionBy("run_id").orderBy("k")), F.lit(0)).alias("upto"))
    mine = gaps.join(owned.select("run_id", "symbol").distinct(), "symbol")
    for end_of, name in (("before", "a"), ("to", "b")):
        mine = mine.join(upto.select("run_id", F.col("k").alias(end_of), F.col("upto").alias(name)), ["run_id", end_of])
    ranges = mine.filter("a < b").select("run_id", "symbol", (F.col("a") + 1).alias("a"), "b")
    since = owned.join(plan.select("run_id", "exec_date", "n"), ["run_id", "exec_date"]).select("run_id", "symbol", "n")
    return since.join(ranges, ["run_id", "symbol"]).filter("b > n").select("run_id", "n", "symbol", F.greatest("a", F.col("n") + 1).alias("a"), "b")


def chains(spans: DataFrame) -> DataFrame:
    """(run_id, n, next): plans that block the one after them, and the first plan that is executed if they were: behind
    all spans that follow on from n without a break."""
    w = Window.partitionBy("run_id", "n").orderBy("a", "b")
    reach = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("n"))
    whole = spans.withColumn("_reach", reach).withColumn("_broken", F.sum((F.col("a") > F.col("_reach") + 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.filter("_broken = 0").groupBy("run_id", "n").agg((F.max("b") + 1).alias("next"))


def reached(blockers: DataFrame) -> DataFrame:
    """(run_id, n, next) of those blockers that are executed: the first of a run, and of any that is executed the first one
    not before its ``next``. Found by pointer jumping: each round doubles how far pointers reach and marks where those of
    marked ones lead, so a run of m executed blockers takes log2(m) rounds, and no row holds a run."""
    w = Window.partitionBy("run_id").orderBy("at", "side").rowsBetween(0, Window.unboundedFollowing)
    asks = blockers.select("run_id", F.col("next").alias("at"), F.lit(0).alias("side"), "n", F.lit(None).cast("long").alias("found"))
    stops = blockers.select("run_id", F.col("n").alias("at"), F.lit(1).alias("side"), "n", F.col("n").cast("long").alias("found"))
    hop = asks.union(stops).withColumn("jump", F.first("found", ignorenulls=True).over(w)).filter("side = 0").select("run_id", "n", "jump")
    first = F.col("n") == F.min("n").over(Window.partitionBy("run_id"))
    table = cut(blockers.join(hop, ["run_id", "n"]).withColumn("reached", first))
    found = True
    while found:
        marked = table.filter("reached AND jump IS NOT NULL").select("run_id", F.col("jump").alias("n"), F.lit(True).alias("_hit"))
        far = table.select("run_id", F.col("n").alias("jump"), F.col("jump").alias("_far"))
        after = table.join(far, ["run_id", "jump"], "left").join(marked.distinct(), ["run_id", "n"], "left")
        fresh = Observation()  # counted by the write: without a new mark there is nothing farther
        after = after.observe(fresh, F.count_if(F.col("_hit") & ~F.col("reached")).alias("n"))
        before, table = table, cut(after.select("run_id", "n", "next", F.col("_far").alias("jump"), (F.col("reached") | F.coalesce("_hit", F.lit(False))).alias("reached")))
        forget(before)
        found = fresh.get["n"] > 0
    return table.filter("reached").select("run_id", "n", "next")


def executions(plan: DataFrame, held: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """(run_id, signal_date, exec_date, before, blocked_by): ``before`` is the plan (its exec_date) that is held when it
    comes; blocked_by the held symbols without a valid open, comma-joined, null if it is executed.

    What a plan blocks follows from itself alone (``chains``), so the only thing that is sequential is which blocking
    plans are executed; the rest follows from the last of those before a plan."""
    at = days.select(F.col("date").alias("exec_date"), F.col("number").alias("k"))
    w = Window.partitionBy("run_id").orderBy("exec_date")
    numbered = cut(plan.join(at, "exec_date").withColumns({"n": F.row_number().over(w), "previous": F.lag("exec_date").over(w)}))
    spans = cut(blocking_spans(numbered, held, prices, days))
    done = cut(reached(chains(spans)))
    by = done.select("run_id", "n", F.col("n").alias("p"), "next").join(numbered.select("run_id", "n", F.col("exec_date").alias("since")), ["run_id", "n"])
    rows = asof_join(numbered, Right(by.withColumn("n", F.col("n") + 1), "n", ["p", "next", "since"], "left"), by="run_id", on="n")
    rows = rows.withColumn("before", F.when(F.col("n") <= F.col("next"), F.col("since")).otherwise(F.col("previous")))
    why = spans.join(done, ["run_id", "n"]).filter("a < next").select("run_id", F.col("n").alias("p"), "symbol", F.explode(F.sequence("a", F.least(F.col("b"), F.col("next") - 1))).alias("n"))
    why = why.groupBy("run_id", "p", "n").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("blocked_by"))
    return rows.join(why, ["run_id", "p", "n"], "left").select("run_id", "signal_date", "exec_date", "before", "blocked_by")


def holding_paths(done: DataFrame, held: DataFrame, prices: DataFrame, days: DataFrame, carry_overnight_on_skip: bool = False) -> DataFrame:
    """(run_id, exec_date, symbol, w, date, ratio, live, exit_ratio): each holding's price ratio to its open on exec_date
    at each session's close up to the next execution; it keeps its last value while open or close is missing, and on
    and after the symbol's last session, when it becomes cash (``live`` false). On the next execution's session, where
    the holding is sold, ``exit_ratio`` is the ratio at the open and ratio is null.

    A skipped execution forgets the overnight move of the holdings, unless ``carry_overnight_on_skip``."""
    w_run = Window.partitionBy("run_id").orderBy("exec_date")
    ran = done.filter("blocked_by IS NULL").select("run_id", "exec_date").withColumn("until", F.lead("exec_date").over(w_run))
    own = held.filter("w > 0").join(ran, ["run_id", "exec_date"]).select("run_id", "exec_date", "until", "symbol", "w", F.col("open_hfq").alias("entry"))
    at = days.select("date", F.col("number").alias("k"))
    end = days.agg(F.max("number").alias("end")).first()["end"]
    own = own.join(at.select(F.col("date").alias("exec_date"), F.col("k").alias("k0")), "exec_date").join(at.select(F.col("date").alias("until"), F.col("k").alias("k1")), "until", "left")
    grid = own.withColumn("k", F.explode(F.sequence("k0", F.coalesce("k1", F.lit(end))))).join(at, "k").drop("k", "k0", "k1")
    last = prices.groupBy("symbol").agg(F.max("date").alias("last_date"))
    grid = grid.join(prices.select("date", "symbol", F.col("open_hfq").alias("o"), F.col("close_hfq").alias("c")), ["date", "symbol"], "left").join(last, "symbol")
    skips = done.filter("blocked_by IS NOT NULL").select("run_id", F.col("exec_date").alias("date"), F.lit(True).alias("skip"))
    grid = grid.join(skips, ["run_id", "date"], "left")
    valid = (F.coalesce(F.col("o"), F.lit(0.0)) != 0) & (F.coalesce(F.col("c"), F.lit(0.0)) != 0)
    w = Window.partitionBy("run_id", "exec_date", "symbol").orderBy("date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("mark", F.when(valid | ((F.col("date") == F.col("last_date")) & (F.coalesce(F.col("c"), F.lit(0.0)) != 0)), F.col("c")))
    grid = grid.withColumn("prev", F.last("mark", ignorenulls=True).over(before))
    lost = F.lit(0.0) if carry_overnight_on_skip else F.coalesce(F.when(F.col("skip") & (F.coalesce(F.col("o"), F.lit(0.0)) != 0) & (F.col("prev") != 0), F.ln(F.col("prev") / F.col("o"))), F.lit(0.0))
    grid = grid.withColumn("lost", lost).withColumn("kept", F.exp(F.sum("lost").over(upto)))
    at_exit = F.col("until").isNotNull() & (F.col("date") == F.col("until"))
    ratio = F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.col("entry")) / F.col("entry") * F.col("kept")
    exit_ratio = F.when(F.col("last_date") >= F.col("date"), F.col("o")).otherwise(F.col("prev")) / F.col("entry") * F.col("kept")
    return grid.select("run_id", "exec_date", "symbol", "w", "date", F.when(~at_exit, ratio).alias("ratio"), F.when(at_exit, F.col("last_date") >= F.col("date")).otherwise(F.col("last_date") > F.col("date")).alias("live"), F.when(at_exit, exit_ratio).alias("exit_ratio"), F.col("mark").alias("close_hfq"), (F.col("date") == F.col("last_date")).alias("ends"))


def rebalances(done: DataFrame, held: DataFrame, paths: DataFrame) -> DataFrame:
    """(run_id, exec_date, symbol, w_new, w_old): target and drift weight at the open of each executed plan; w_old is 0
    for what is not held, w_new 0 for what is sold. ``growth``: of the whole portfolio since the plan before."""
    out = paths.filter("exit_ratio IS NOT NULL")
    cash = held.groupBy("run_id", "exec_date").agg((1 - F.sum("w")).alias("cash"))
    gone = out.groupBy("run_id", "exec_date", F.col("date").alias("at")).agg(F.sum(F.col("w") * F.col("exit_ratio")).alias("v")).join(cash, ["run_id", "exec_date"])
    growth = gone.select("run_id", F.col("at").alias("exec_date"), (F.col("cash") + F.col("v")).alias("growth"))
    old = out.filter("live").select("run_id", F.col("date").alias("exec_date"), "symbol", (F.col("w") * F.col("exit_ratio")).alias("v"))
    ran = done.filter("blocked_by IS NULL").select("run_id", "exec_date", "signal_date")
    new = held.join(ran, ["run_id", "exec_date", "signal_date"]).select("run_id", "exec_date", "symbol", F.col("w").alias("w_new"))
    met = new.join(old, ["run_id", "exec_date", "symbol"], "full_outer").join(growth, ["run_id", "exec_date"], "left")
    return met.select("run_id", "exec_date", "symbol", F.coalesce("w_new", F.lit(0.0)).alias("w_new"), F.coalesce(F.col("v") / F.col("growth"), F.lit(0.0)).alias("w_old"), "growth")


def levels(done: DataFrame, rebalanced: DataFrame, held: DataFrame, config: Config) -> DataFrame:
    """(run_id, exec_date, signal_date, turnover, before, after, cash): the portfolio's value at the open of each executed
    plan before and after costs, and the plan's cash share. The value is a running product over a run's plans."""
    turn = rebalanced.groupBy("run_id", "exec_date").agg(F.sum(F.abs(F.col("w_new") - F.col("w_old"))).alias("turnover"), F.max("growth").alias("growth"))
    cash = held.groupBy("run_id", "exec_date").agg((1 - F.sum("w")).alias("cash"))
    ran = done.filter("blocked_by IS NULL").select("run_id", "exec_date", "signal_date").join(turn, ["run_id", "exec_date"], "left").join(cash, ["run_id", "exec_date"], "left")
    ran = ran.withColumns({"turnover": F.coalesce("turnover", F.lit(0.0)), "cash": F.coalesce("cash", F.lit(1.0)), "growth": F.coalesce("growth", F.lit(1.0))})
    kept = 1 - F.lit(config.rate) * F.col("turnover")
    w = Window.partitionBy("run_id").orderBy("exec_date").rowsBetween(Window.unboundedPreceding, -1)
    ran = ran.withColumn("_step", F.col("growth") * kept)
    ran = ran.withColumn("before", F.lit(float(config.capital)) * F.coalesce(F.product("_step").over(w), F.lit(1.0)) * F.col("growth"))
    return ran.select("run_id", "exec_date", "signal_date", "turnover", "before", (F.col("before") * kept).alias("after"), "cash")


def trades(done: DataFrame, rebalanced: DataFrame, level: DataFrame, paths: DataFrame, prices: DataFrame, config: Config) -> DataFrame:
    """The ledger: BUY and SELL at executed plans, SKIP_REBALANCE with the blocking symbols, DELIST at a held symbol's last
    close, without cost."""
    at = prices.select(F.col("date").alias("exec_date"), "symbol", "open", "open_hfq")
    met = rebalanced.join(level.select("run_id", "exec_date", "signal_date", "before"), ["run_id", "exec_date"]).join(at, ["exec_date", "symbol"])
    notional = F.abs(F.col("w_new") * F.col("before") - F.col("w_old") * F.col("before"))
    none, text = F.lit(None).cast("double"), F.lit
    deals = met.filter(F.col("w_new") != F.col("w_old")).select("run_id", F.col("exec_date").alias("date"), "signal_date", "symbol", F.when(F.col("w_new") > F.col("w_old"), "BUY").otherwise("SELL").alias("side"), F.col("open").alias("raw_open"), F.col("open_hfq").alias("adjusted_open"), notional.alias("notional"), (notional * F.lit(config.rate)).alias("cost"), text("monthly_rebalance").alias("reason"))
    skips = done.filter("blocked_by IS NOT NULL").select("run_id", F.col("exec_date").alias("date"), "signal_date", F.col("blocked_by").alias("symbol"), text("SKIP_REBALANCE").alias("side"), none.alias("raw_open"), none.alias("adjusted_open"), F.lit(0.0).alias("notional"), F.lit(0.0).alias("cost"), text("held_symbol_missing_open").alias("reason"))
    ends = paths.filter("ends AND ratio IS NOT NULL AND close_hfq IS NOT NULL").join(level.select("run_id", "exec_date", "after"), ["run_id", "exec_date"])
    ends = ends.select("run_id", "date", F.lit(None).cast("date").alias("signal_date"), "symbol", text("DELIST").alias("side"), none.alias("raw_open"), F.col("close_hfq").alias("adjusted_open"), (F.col("after") * F.col("w") * F.col("ratio")).alias("notional"), F.lit(0.0).alias("cost"), text("delisted_liquidation").alias("reason"))
    return deals.unionByName(skips).unionByName(ends)


def daily_nav(level: DataFrame, paths: DataFrame, days: DataFrame, runs: DataFrame, config: Config) -> DataFrame:
    """(run_id, date, nav, cash, positions_value) for each session; before the first execution all is cash. runs: run_id."""
    held = paths.filter("ratio IS NOT NULL").groupBy("run_id", "exec_date", "date").agg(F.sum(F.col("w") * F.col("ratio")).alias("all"), F.sum(F.when(F.col("live"), F.col("w") * F.col("ratio")).otherwise(0.0)).alias("live"))
    dates = F.array_sort(F.collect_set("date"))
    grid = runs.select("run_id").distinct().withColumn("k", F.lit(1)).join(days.groupBy(F.lit(1).alias("k")).agg(dates.alias("dates")), "k").select("run_id", F.explode("dates").alias("date"))
    own = level.select("run_id", "exec_date", F.col("exec_date").alias("of"), "after", F.col("cash").alias("share"))
    met = asof_join(grid, Right(own, "exec_date", ["of", "after", "share"], "left"), by="run_id")
    met = met.join(held.withColumnRenamed("exec_date", "of"), ["run_id", "of", "date"], "left")
    out = met.select("run_id", "date", (F.col("after") * (F.col("share") + F.coalesce("all", F.lit(0.0)))).alias("nav"), (F.col("after") * F.coalesce("live", F.lit(0.0))).alias("positions_value"))
    out = out.withColumns({"nav": F.coalesce("nav", F.lit(float(config.capital))), "positions_value": F.coalesce("positions_value", F.lit(0.0))})
    return out.select("run_id", "date", "nav", (F.col("nav") - F.col("positions_value")).alias("cash"), "positions_value")


def benchmark_nav(days: DataFrame, benchmark: DataFrame, config: Config) -> DataFrame:
    """(date, benchmark_nav): the benchmark's (date, close_hfq) last close as of each session over the first one, times
    the capital; of repeated dates the last by value; nulls before the first close."""
    rows = first_by(benchmark.filter("close_hfq IS NOT NULL").select("date", "close_hfq"), ["date"], F.desc("close_hfq")).withColumn("k", F.lit(1))
    met = asof_join(days.select("date", F.lit(1).alias("k")), Right(rows, "date", ["close_hfq"], "left"), by="k")
    w = Window.partitionBy("k").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return met.select("date", (F.col("close_hfq") / F.first("close_hfq", ignorenulls=True).over(w) * F.lit(float(config.capital))).alias("benchmark_nav"))


@dataclass
class Result:
    daily_nav: DataFrame
    trades: DataFrame
    executions: DataFrame
    paths: DataFrame
    rebalances: DataFrame
    levels: DataFrame
    tables: list[DataFrame]

    def release(self) -> None:
        """Delete the tables that the results are read from; none of them can be used afterwards."""
        for df in self.tables:
            forget(df)


def watch_prices(prices: DataFrame) -> tuple[DataFrame, Watch]:
    """prices, and the watch over rows that have a valid open and no close."""
    return watch(prices, F.expr("open_hfq IS NOT NULL AND open_hfq != 0 AND close_hfq IS NULL"), ["symbol", "date"], "{0} has an open but no close on {1}")


def evaluate(prices: DataFrame, targets: DataFrame, config: Config, carry_overnight_on_skip: bool = False) -> Result:
    """All results of all runs in ``targets`` (with run_id); raises if the period has no session, if targets break their
    contract, or if a price row has an open and no close.

    Each step is written to the shared folder and read again: steps use several of those before, and without the cut
    the plan would double with each. Prices are read for the sessions and once more for the symbols of the targets; the
    tables grow with those symbols' prices, the targets, and the days they are held;
    ``Result.release`` deletes them, else the end of the driver's Python does."""
    own = within(prices, config).select("date", "symbol", "open", "open_hfq", "close_hfq")
    watched, prices_hold = watch_prices(own)  # both contracts are checked by the writes that come anyway
    days = cut(sessions(watched, config))
    prices_hold.verify()
    if days.isEmpty():
        raise ValueError("the period has no session")
    watched, targets_hold = watch_targets(targets.select("run_id", "date", "symbol", "target_weight"), ("run_id", "date"))
    targets = cut(watched)
    targets_hold.verify()
    own = cut(own.join(targets.select("symbol").distinct(), "symbol", "left_semi"))  # all that follows asks only for targets' symbols
    plan = cut(plans(targets, days))
    held = cut(weights(targets, plan, own))
    done = cut(executions(plan, held, own, days))
    paths = cut(holding_paths(done, held, own, days, carry_overnight_on_skip))
    moved = cut(rebalances(done, held, paths))
    level = cut(levels(done, moved, held, config))
    return Result(daily_nav(level, paths, days, targets, config), trades(done, moved, level, paths, own, config), done, paths, moved, level, [days, targets, own, plan, held, done, paths, moved, level])
