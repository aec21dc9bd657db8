"""Portfolio evaluation against hand cases and an independent loop over days."""

import random
from datetime import date, timedelta

import pytest

from tidemark.plans import portfolio

PRICES = "date date, symbol string, open double, open_hfq double, close_hfq double"
TARGETS = "run_id string, date date, symbol string, target_weight double"


def evaluate(spark, prices, targets, capital=100_000.0, **more):
    days = sorted({p[0] for p in prices})
    config = portfolio.Config(str(days[0]), str(days[-1]), capital, 5.0, 5.0)
    r = portfolio.evaluate(spark.createDataFrame(prices, PRICES), spark.createDataFrame(targets, TARGETS), config, **more)
    return {(x.run_id, x.date): x for x in r.daily_nav.collect()}, r.trades.collect()


def test_execution_at_the_next_open(spark):
    d = [date(2024, 1, k) for k in (2, 3, 4)]
    prices = [(d[0], "A", 100.0, 100.0, 100.0), (d[1], "A", 100.0, 100.0, 110.0), (d[2], "A", 110.0, 110.0, 110.0)]
    nav, trades = evaluate(spark, prices, [("r", d[0], "A", 1.0)])
    assert nav["r", d[0]].nav == 100_000 and nav["r", d[1]].nav == pytest.approx(109_890)
    buy = next(t for t in trades if t.side == "BUY")
    assert (buy.date, buy.notional, buy.cost) == (d[1], 100_000, 100) and nav["r", d[2]].positions_value == 0
    assert [t.notional for t in trades if t.side == "DELIST"] == [pytest.approx(109_890)]


def test_missing_open_stays_cash(spark):
    d = [date(2024, 1, k) for k in (2, 3)]
    nav, trades = evaluate(spark, [(d[0], "A", 1.0, 1.0, 1.0), (d[1], "A", None, None, 1.0)], [("r", d[0], "A", 1.0)])
    assert not trades and nav["r", d[1]].cash == 100_000


def loop(prices, targets, capital, rate, carry=False):
    """A plain loop over days with values, as the semantics are told."""
    days = sorted({p[0] for p in prices})
    at = {(p[0], p[1]): p for p in prices}
    last = {p[1]: p[0] for p in sorted(prices)}
    plan = {}
    for day in sorted({t[1] for t in targets}):
        if later := [x for x in days if x > day]:
            plan[later[0]] = {t[2]: t[3] for t in targets if t[1] == day}
    held, close, cash, out, skips = {}, {}, capital, {}, 0
    for day in days:
        opened, blocked = {}, set()
        for s, v in held.items():
            p = at.get((day, s))
            if p and p[3] and close.get(s):
                opened[s] = v * p[3] / close[s]
            else:
                opened[s] = v
                blocked.add(s)
        if day in plan:
            if blocked:
                skips += 1
                held = opened if carry else held
            else:
                w = {s: x for s, x in plan[day].items() if at.get((day, s)) and at[day, s][3] is not None}
                total = cash + sum(opened.values())
                cost = rate * sum(abs(w.get(s, 0) * total - opened.get(s, 0)) for s in {*w, *opened})
                held = {s: x * (total - cost) for s, x in w.items()}
                cash = (total - cost) * (1 - sum(w.values()))
        else:
            held = opened
        for s in list(held):
            p = at.get((day, s))
            if p and p[3] and p[4]:
                held[s] *= p[4] / p[3]
                close[s] = p[4]
            if last[s] == day and p and p[4]:
                cash += held.pop(s) * (p[4] / close[s] if close.get(s) else 1)
                close.pop(s, None)
        out[day] = cash + sum(held.values())
    return out, skips


@pytest.mark.parametrize("carry", [False, True])
def test_against_a_loop_over_days(spark, carry):
    rng = random.Random(11)
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(40)]
    prices = []
    for s in "ABCDEF":
        end = rng.choice([40, 40, 40, 25, 33])
        price = 100.0
        for k, day in enumerate(days[:end]):
            price *= rng.uniform(0.95, 1.05)
            if rng.random() < 0.06 and k not in (0, end - 1):
                continue
            o = None if rng.random() < 0.04 and k < end - 1 else price * rng.uniform(0.98, 1.02)
            prices.append((day, s, o, o, price))
    targets, expected, skips = [], {}, 0
    for run in range(8):
        own = []
        for day in range(rng.randint(0, 3), 39, rng.randint(4, 7)):
            chosen = rng.sample("ABCDEF", rng.randint(1, 4))
            own += [(f"r{run}", days[day], s, rng.uniform(0.5, 1) / len(chosen)) for s in chosen]
        targets += own
        nav, n = loop(prices, own, 100_000.0, 0.001, carry)
        skips += n
        expected |= {(f"r{run}", d): v for d, v in nav.items()}
    got, _ = evaluate(spark, prices, targets, carry_overnight_on_skip=carry)
    assert skips > 0 and got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k].nav == pytest.approx(v, rel=1e-9), k


def fold(plans, held, opens, last):
    """Which plans are executed, one after the other."""
    now, out = None, []
    for day in plans:
        missing = sorted(s for s in held.get(now, ()) if last[s] >= day and day not in opens[s])
        out.append((day, now, ",".join(missing) or None))
        now = now if missing else day
    return out


@pytest.mark.parametrize("gap", [0.05, 0.5, 0.9])
def test_executions_against_a_fold(spark, gap):
    """Many plans and gaps: chains of several symbols' gaps, skipped plans that would have blocked others."""
    rng = random.Random(int(gap * 100))
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(60)]
    last = {s: rng.choice(days[20:]) for s in "ABCDE"} | {"A": days[-1]}
    opens = {s: {d for d in days if d <= last[s] and (rng.random() >= gap or d == days[0])} for s in last}
    prices = [(d, s, 1.0, 1.0, 1.0) if d in opens[s] else (d, s, None, None, 1.0) for s in last for d in days if d <= last[s] and (d in opens[s] or d == last[s] or rng.random() < 0.5)]
    frame, config = spark.createDataFrame(prices, PRICES), portfolio.Config(str(days[0]), str(days[-1]))
    plans, held, want = [], [], []
    for run in range(4):
        own = [d for d in sorted({p[0] for p in prices})[1:] if rng.random() < 0.7]  # plans lie on sessions
        mine = {d: [s for s in rng.sample("ABCDE", rng.randint(0, 3)) if d in opens[s]] for d in own}
        plans += [(f"r{run}", d - timedelta(days=1), d) for d in own]
        held += [(f"r{run}", d, s, 0.1) for d, symbols in mine.items() for s in symbols]
        want += [(f"r{run}", *x) for x in fold(own, mine, opens, last)]
    got = portfolio.executions(spark.createDataFrame(plans, "run_id string, signal_date date, exec_date date"), spark.createDataFrame(held, "run_id string, exec_date date, symbol string, w double"), frame, portfolio.sessions(frame, config))
    assert sorted((r.run_id, r.exec_date, r.before, r.blocked_by) for r in got.collect()) == sorted(want)
    assert any(r[3] for r in want)


def test_ten_thousand_plans_a_run(spark):
    """Pointer jumping over a run of blocking plans, and a run that blocks nothing."""
    rng = random.Random(2)
    spans = [("long", n, "S", n + 1, n + rng.randint(1, 4)) for n in range(1, 10_000) if rng.random() < 0.6] + [("short", 5, "S", 6, 7)]
    ends = {(r, n): b + 1 for r, n, _, _, b in spans}
    got = {(r.run_id, r.n) for r in portfolio.reached(portfolio.chains(spark.createDataFrame(spans, "run_id string, n int, symbol string, a int, b int"))).collect()}
    want, n = {("short", 5)}, 1
    while n < 10_000:
        if after := ends.get(("long", n)):
            want.add(("long", n))
        n = after or n + 1
    assert got == want and len(want) > 1000


def test_levels_of_ten_thousand_plans(spark):
    """A running product, against a loop."""
    rng, config = random.Random(6), portfolio.Config("2000-01-01", "2030-01-01", 1000.0, 5.0, 5.0)
    days = [date(2000, 1, 1) + timedelta(days=k) for k in range(10_000)]
    moved = [("r", d, "A", rng.random(), rng.random(), rng.uniform(0.99, 1.0101)) for d in days]
    done = spark.createDataFrame([("r", d, d, None) for d in days], "run_id string, exec_date date, signal_date date, blocked_by string")
    held = spark.createDataFrame([("r", d, 0.4) for d in days], "run_id string, exec_date date, w double")
    got = {r.exec_date: r for r in portfolio.levels(done, spark.createDataFrame(moved, "run_id string, exec_date date, symbol string, w_new double, w_old double, growth double"), held, config).collect()}
    value = 1000.0
    for _, d, _, new, old, growth in moved:
        before = value * growth
        value = before * (1 - 0.001 * abs(new - old))
        assert got[d].before == pytest.approx(before, rel=1e-9) and got[d].after == pytest.approx(value, rel=1e-9) and got[d].cash == pytest.approx(0.6)


def test_prices_are_read_for_the_symbols_of_the_targets_only(spark, tmp_path):
    """After the sessions are known, steps read a table of those symbols, whatever else has prices."""
    d = [date(2024, 1, k) for k in (2, 3, 4)]
    prices = [(x, s, 10.0, 10.0, 10.0 + i) for i, x in enumerate(d) for s in ["A", *(f"other{k}" for k in range(50))]]
    spark.createDataFrame(prices, PRICES).write.parquet(f"{tmp_path}/prices")
    r = portfolio.evaluate(spark.read.parquet(f"{tmp_path}/prices"), spark.createDataFrame([("r", d[0], "A", 1.0)], TARGETS), portfolio.Config(str(d[0]), str(d[-1])))
    for df in (r.trades, r.daily_nav):
        assert not any("prices" in f for f in df.inputFiles())
    assert [(x.side, x.symbol) for x in sorted(r.trades.collect(), key=lambda x: x.date)] == [("BUY", "A"), ("DELIST", "A")] and r.daily_nav.count() == 3
