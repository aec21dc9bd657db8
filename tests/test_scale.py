"""Plans without shuffles, slices of long symbols, contracts in passing, schemas from footers."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators.contracts import watch
from tidemark.plans import factors, ingest, strategies, ttm, valuation
from tidemark.sources import bridge, buckets, scans

SF = f"{DATA}/sf0.001"
PRICE = ["price_momentum_120d", "price_trend_gap_120d", "price_trend_above_ma_120d", "price_volatility_60d"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tables_in_buckets_meet_without_an_exchange(spark, tmp_path):
    filings = bridge.table(spark, SF, "filings").cache()
    tables = {"t_bars": bridge.table(spark, SF, "daily_kline"), "t_capital": bridge.table(spark, SF, "share_capital"), "t_ttm": ttm.ttm(filings), "t_filings": filings}
    for name, df in tables.items():
        buckets.write_bucketed(df, name, 6, path=str(tmp_path / name))
    own = [buckets.bucketed(spark, name, 6) for name in tables]
    panel = valuation.daily_valuation(*own)
    priced = factors.calculate(panel, PRICE)  # windows by symbol go on in the same buckets
    for df in (panel, priced):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(panel) == rows(valuation.daily_valuation(*tables.values()))
    one = own[0].filter("symbol = '000003'").join(own[1].filter("symbol = '000003'").hint("merge"), "symbol")
    plan = one._jdf.queryExecution().toString()
    assert plan.count("SelectedBucketsCount: 1 out of 6") >= 2 and "Exchange" not in plan
    with pytest.raises(ValueError, match="buckets"):
        buckets.bucketed(spark, "t_bars", 7)
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
    filings.unpersist()


@pytest.mark.parametrize("length", [3, 50, 130, 5000])
def test_sliced_factors_equal_whole_ones(spark, length):
    """Also where gaps push a look-back over several slices, and for a symbol with fewer rows than it."""
    rng = random.Random(3)
    data = [(s, dt.date(2000, 1, 1) + dt.timedelta(days=k), rng.choice([None, *[rng.uniform(1, 9)] * 20])) for s, share in (("a", 1), ("b", 0.5), ("c", 0.1)) for k in range(420) if rng.random() < share and not (s == "b" and 150 < k < 320)]
    panel = spark.createDataFrame(data, "symbol string, date date, close_hfq double")
    names = ["price_momentum_120d", "price_volatility_60d", "price_trend_gap_120d"]
    short = {"price_momentum_120d": {"lookback_days": 40}, "price_trend_gap_120d": {"trend_window": 30}, "price_volatility_60d": {"volatility_window": 25}}
    got = factors.calculate_sliced(panel, names, length, short)
    want = factors.calculate(panel, names, short)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert factors.calculate_sliced(panel.limit(0), names, length).count() == 0


def executed(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_a_contract_costs_no_job(spark, tmp_path):
    good = [("a", dt.date(2000, 1, k), 1.0) for k in (3, 4, 5)]
    schema = "symbol string, date date, close_hfq double"
    make = lambda *more: spark.createDataFrame([*good, *more], schema)
    made, watched = factors.calculate_watched(make(), PRICE)
    before = executed(spark)
    made.write.parquet(str(tmp_path / "good"))
    watched.verify()
    assert executed(spark) == before + 1
    assert rows(spark.read.parquet(str(tmp_path / "good")).select("symbol", "date")) == [x[:2] for x in good]
    for k, bad in enumerate((("a", dt.date(2000, 1, 4), 2.0), ("a", None, 1.0), (None, dt.date(2000, 1, 4), 1.0))):
        made, watched = factors.calculate_watched(make(bad), PRICE)
        made.write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError, match="null or repeated key"):
            watched.verify()
        with pytest.raises(ValueError, match="null or repeated key"):  # as the check by a job of its own
            factors.calculate(make(bad), PRICE, check_rows=True)


@pytest.mark.parametrize("bad", [("B", 0.6), ("A", 0.1), (None, 0.1), ("B", 0.0), ("B", None)])
def test_targets_are_watched_as_they_are_checked(spark, bad):
    day = dt.date(2000, 1, 31)
    make = lambda *r: spark.createDataFrame([("r", day, *x) for x in r], "run_id string, date date, symbol string, target_weight double")
    by = ("run_id", "date")
    df, watched = strategies.watch_targets(make(("A", 0.5), ("B", 0.5)), by)
    assert df.count() == 2
    df.collect()
    watched.verify()
    with pytest.raises(ValueError, match="not valid"):
        strategies.check_targets(make(("A", 0.5), bad), by)
    df, watched = strategies.watch_targets(make(("A", 0.5), bad), by)
    df.collect()
    with pytest.raises(ValueError, match="targets of 2000-01-31 are not valid"):
        watched.verify()


def test_a_watch_over_no_rows(spark):
    df, watched = watch(spark.range(0), F.lit(True), ["id"], "{0}")
    df.collect()
    watched.verify()


def test_a_folder_of_three_schemas(spark, tmp_path):
    path = str(tmp_path / "mixed files")
    spark.createDataFrame([("a", 1, "7")], "k string, n int, t string").coalesce(1).write.parquet(f"{path}/symbol=000001")
    spark.createDataFrame([("b", 2.5, 9)], "k string, n double, t int").coalesce(1).write.parquet(f"{path}/symbol=000002")
    spark.createDataFrame([(8, "c"), (None, "d")], "n long, k string").coalesce(1).write.parquet(f"{path}/symbol=000003")
    spark.createDataFrame([("e", 3, "8")], "k string, n int, t string").coalesce(1).write.parquet(f"{path}/symbol=000004")
    got = scans.union_folder(spark, path)
    assert dict(got.dtypes) == {"k": "string", "n": "double", "t": "int", "symbol": "string"}
    assert rows(got.select("symbol", "k", "n", "t")) == [("000001", "a", 1.0, 7), ("000002", "b", 2.5, 9), ("000003", "c", 8.0, None), ("000003", "d", None, None), ("000004", "e", 3.0, 8)]
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 3  # one a schema, not a file
    assert rows(scans.schema_summary(spark, path)) == sorted([("k", "string", 3, 5), ("n", "int", 1, 2), ("n", "double", 1, 1), ("n", "bigint", 1, 2), ("t", "string", 1, 2), ("t", "int", 1, 1)], key=repr)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no Parquet file"):
        scans.union_folder(spark, str(tmp_path / "none"))


def test_order_within_files_is_seen(spark):
    data = spark.createDataFrame([("f", 0, "a", 1), ("f", 1, "a", 3), ("f", 2, "a", 2), ("g", 0, "a", 9), ("g", 1, "b", 1)], "file string, at int, symbol string, date int")
    assert rows(ingest.out_of_order(data, "file", "at", "symbol", "date")) == [("a", 4, 2, 1), ("b", 1, 1, 0)]


def test_rolled_columns_equal_moving_frames(spark):
    """With gaps, and of a series so flat that a difference of sums of squares would be noise."""
    rng = random.Random(5)
    x = lambda s, k: {"a": rng.choice([None, *[rng.uniform(-9, 9)] * 30]), "b": 1e6, "c": 1e6 + k % 2 * 1e-3}[s]
    panel = spark.createDataFrame([(s, dt.date(2000, 1, 1) + dt.timedelta(days=k), x(s, k)) for s in "abc" for k in range(150)], "symbol string, date date, x double")
    for n in (1, 2, 7, 60, 120, 151):
        needs = [("mean", n, "x"), *([("deviation", n, "x")] if n > 1 else [])]
        w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - n, 0)
        whole = F.count("x").over(w) == n
        for r in factors.rolled(panel, needs).withColumns({"m": F.when(whole, F.avg("x").over(w)), "d": F.when(whole, F.stddev_samp("x").over(w))}).collect():
            for got, want in zip([r[f"_{kind}_{n}_x"] for kind, *_ in needs], (r.m, r.d)):
                assert got is None and want is None or got == pytest.approx(want, rel=1e-12, abs=1e-9)
                assert r.symbol != "b" or got in (None, 1e6, 0.0)
    plan = factors.calculate(panel.withColumnRenamed("x", "close_hfq"), PRICE)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -119" not in plan and "RowFrame, -59" not in plan and plan.count("Exchange") == 1


def test_a_strategy_computes_its_panel_once(spark):
    """Its month ends, quantiles and ranks are taken from the few rows that are written."""
    rng, seen = random.Random(4), spark.sparkContext.accumulator(0)
    data = [(s, dt.date(2000, 1, 1) + dt.timedelta(days=k), *(rng.uniform(1, 9) for _ in range(5))) for s in "abcdefgh" for k in range(400) if rng.random() < 0.9]
    panel = spark.sparkContext.parallelize(data, 2).map(lambda r: seen.add(1) or r).toDF("symbol string, date date, close_hfq double, pe_ttm double, pb double, roe_weighted double, operating_cashflow_to_revenue double")
    got = rows(strategies.multi_factor_targets(panel, "2000-11-05", {"min_listing_days": 200}))
    assert seen.value == len(data)
    ends = {max(x[1] for x in data if x[1].month == m and x[1].year == y) for y, m in ((2000, 11), (2000, 12), (2001, 1), (2001, 2))}
    want = {(d, s) for s, d in ((x[0], x[1]) for x in data) if d in ends and sum(x[0] == s and x[1] <= d for x in data) >= 200}
    assert {r[:2] for r in got} == want
    assert all(r[4] == 1 / sum(x[0] == r[0] for x in want) for r in got)


def test_the_first_ranks_are_chosen_before_the_shuffle(spark):
    """No date's symbols are moved to one task to find its first three; ties go by symbol as before."""
    rng = random.Random(6)
    slope, price = ({s: rng.choice(of) for s in "abcdefghijklmnopqrstuvwxyz"} for of in ((0.1, 0.2, 0.3), (4.0, 5.0, 6.0, 7.0, 8.0)))
    panel = spark.createDataFrame([(s, dt.date(2000, 1, 1) + dt.timedelta(days=k), 10 + slope[s] * k, price[s], price[s], 9.0, 1.0) for s in slope for k in range(300)], "symbol string, date date, close_hfq double, pe_ttm double, pb double, roe_weighted double, operating_cashflow_to_revenue double")
    for name, make in strategies.STRATEGIES.items():
        got = make(panel, "2000-07-01", {"holding_count": 3})
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString(), name
        whole = rows(make(panel, "2000-07-01", {"holding_count": 100}).select("date", "symbol", "score", "rank"))
        assert rows(got.select("date", "symbol", "score", "rank")) == [r for r in whole if r[3] <= 3] and len(whole) > len([r for r in whole if r[3] <= 3]) > 0
        up = name == "quality-value-recovery"
        for day in {r[0] for r in whole}:
            mine = sorted((r for r in whole if r[0] == day), key=lambda r: r[3])
            assert [r[1] for r in mine] == [r[1] for r in sorted(mine, key=lambda r: (r[2] if up else -r[2], r[1]))]


def test_trailing_figures_shuffle_filings_once(spark):
    """Frames over a symbol's periods find what a lookup by period finds, also with gaps, odd periods and no symbol."""
    rng = random.Random(8)
    days = [f"{y}{md}" for y in range(1999, 2005) for md in ("0331", "0430", "0630", "0930", "1231")] + ["20000229", "20010228", "20040229"]
    data = [(s, sym, d, f"{d}", *(rng.choice([None, rng.uniform(1, 9), 2.0]) for _ in range(4))) for s in ("income", "cashflow", "indicator") for sym in ("a", "b", None) for d in days if rng.random() < 0.8]
    filed = spark.createDataFrame(data, "source string, symbol string, report_date string, publish_date string, net_profit double, revenue double, ocf double, deduct_net_profit double")
    cur = {}
    for source, sym, d, _, *values in data:
        for (m, of), v in zip(ttm.METRICS.items(), values):
            if of == source:
                cur.setdefault((sym, d), {})[m] = v
    want = set()
    for (sym, d), now in cur.items():
        y = int(d[:4]) - 1
        end, same = (({} if sym is None else cur.get((sym, k), {})) for k in (f"{y}1231", f"{y}{d[4:]}"))
        out = [None if None in (now.get(m), end.get(m), same.get(m)) else now[m] + (end[m] - same[m]) for m in ("net_profit", "deduct_net_profit", "revenue", "ocf")]
        if any(v is not None for v in out):
            want.add((sym, d, d, *out))
    got = ttm.ttm(filed)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count(" Exchange ") == 1 and plan.count("Scan ExistingRDD") == 1


def test_filings_are_those_of_the_sql_from_one_pass(spark):
    want = spark.sql(f"WITH {', '.join(f'{k} AS ({bridge.CTES[k]})' for k in ('li', 'q', 'fin', 'filed'))} {bridge.CTES['filings']}", lineitem=spark.read.parquet(f"{SF}/lineitem.parquet"))
    got = bridge.table(spark, SF, "filings")
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert plan(got) == 1 and plan(want) == 4
