"""Hand-computed cases of the market library."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import market as M
from tidemark.operators import cross_section as X
from tidemark.operators.asof import Right, asof_join
from tidemark.operators.dedupe import assert_unique, keep_last
from tidemark.plans import factors, filings, ingest, metrics, planning, strategies, ttm, universe, valuation
from tidemark.sources import payloads, scans


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_dates(spark):
    got = one(spark, [("2016-10-25 00:00:00",), ("20151027",), ("20241301",), (None,), ("invalid",)], "x string", D.normalize_date(F.col("x")))
    assert [r[0] for r in got] == ["20161025", "20151027", None, None, None]
    r = F.col("x")
    got = one(spark, [("20240331",), ("20240630",), ("20240930",), ("20241231",), ("20240101",)], "x string", D.deadline(r), D.report_type(r), D.previous_quarter(r), D.prior_year_same(r))
    assert [g[0] for g in got] == [date(2024, 4, 30), date(2024, 8, 31), date(2024, 10, 31), date(2025, 4, 30), None]
    assert [g[1] for g in got] == ["q1", "semiannual", "q3", "annual", None]
    assert [g[2] for g in got] == ["20231231", "20240331", "20240630", "20240930", "20240101"]
    assert got[3][3] == "20231231"
    assert one(spark, [("20250930",)], "x string", D.quarters_back(r, 5)) == [(["20250930", "20250630", "20250331", "20241231", "20240930"],)]
    assert one(spark, [(date(2025, 5, 2),)], "x date", D.quarters_before(r)) == [(["20250331", "20241231", "20240930", "20240630"],)]
    got = one(spark, [(20241030.0,), (1730246400.0,), (1730246400000.0,)], "x double", D.parse_number_date(r))
    assert [g[0] for g in got] == [date(2024, 10, 30)] * 3


def test_latest_session(spark):
    calendar = spark.createDataFrame([(date(2026, 8, 6),), (date(2026, 8, 7),)], "trade_date date")
    for now, expected in (("2026-08-08 10:00:00", 7), ("2026-08-07 14:00:00", 6), ("2026-08-07 15:30:00", 7), ("2026-08-07 16:00:00", 7)):
        assert D.latest_session(calendar, F.lit(now).cast("timestamp")).first()[0] == date(2026, 8, expected)


def test_titles(spark):
    cases = [("某公司2024年年度报告", "20241231", True), ("某公司2024年半年度报告", "20241231", False), ("某公司2024年半年度报告", "20240630", True), ("2024年第一季度报告摘要", "20240331", False), ("2023年年度报告", "20241231", False), (None, "20241231", False)]
    got = one(spark, cases, "t string, r string, e boolean", D.title_matches(F.col("t"), F.col("r")), "e")
    assert all(a == b for a, b in got)


def test_market_codes(spark):
    codes = {"600519": "SH", "900901": "SH", "510300": "SH", "000001": "SZ", "300750": "SZ", "200011": "SZ", "159915": "SZ", "430047": "BJ", "830799": "BJ", "920002": "BJ", "950001": "SH"}
    assert dict(one(spark, [(c,) for c in codes], "c string", "c", M.exchange(F.col("c")))) == codes
    assert one(spark, [("sz300274",), ("300274.sz",)], "c string", M.market_symbol(F.col("c"))) == [("300274.SZ",)] * 2
    places = [("江苏省南京市", "江苏"), ("中国（安徽）自由贸易试验区", "安徽"), ("未知", None), (None, None)]
    assert all(a == b for a, b in one(spark, places, "a string, e string", M.province(F.col("a")), "e"))


def _filings(spark, rows):
    return spark.createDataFrame(rows, "source string, symbol string, report_date string, publish_date string, available_date string")


def test_reconciliation(spark):
    rows = []
    for source in ("balance", "income", "cashflow", "indicator"):
        rows.append((source, "1", "20150930", "20151027" if source == "balance" else "20161025", None))
        rows.append((source, "1", "20160930", "20161025" if source in ("balance", "indicator") else "20171025", None))
    out = filings.reconcile(_filings(spark, rows))
    assert {(r.report_date, r.publish_date, r.available_date) for r in out.collect()} == {("20150930", "20151027", "20161025"), ("20160930", "20161025", "20171025")}
    assert {tuple(r) for r in filings.changed_rows(out).collect()} == {(s, 2, 2) for s in ("balance", "income", "cashflow", "indicator")}


def test_overdue_and_official(spark):
    late = [("balance", "1", "20240930", "20241102", None), ("income", "1", "20240930", "20241101", None), ("balance", "2", "20240930", "20241031", None), ("income", "2", "20240930", "20241101", None)]
    df = _filings(spark, late)
    over = filings.overdue(df, F.lit("2025-01-01").cast("date"))
    assert [(r.symbol, r.publish) for r in over.collect()] == [("1", date(2024, 11, 1))]
    said = spark.createDataFrame([("1", date(2024, 10, 30), "2024年第三季度报告", "b"), ("1", date(2024, 10, 25), "2024年第三季度报告摘要", "a"), ("1", date(2024, 10, 30), "2024年第三季度报告", "a")], "symbol string, publish_date date, title string, url string")
    official = filings.first_disclosures(over, said)
    assert [(r.official, r.url) for r in official.collect()] == [(date(2024, 10, 30), "a")]
    fixed = {(r.symbol, r.source): (r.publish_date, r.changed) for r in filings.apply_official(df, official).collect()}
    assert fixed["1", "balance"] == ("20241030", True) and fixed["2", "income"] == ("20241101", False)
    assert filings.unresolved(over, official).count() == 0


def _periods(values, skip=(), source="income"):
    return [(source, "1", p, str(int(p) + 100), None, float(v), None, None, None) for p, v in values.items() if p not in skip]


FIN = "source string, symbol string, report_date string, publish_date string, available_date string, net_profit double, revenue double, ocf double, deduct_net_profit double"


def test_ttm(spark):
    values = {"20220331": 50, "20220630": 110, "20220930": 180, "20221231": 260, "20230331": 60, "20230630": 130, "20230930": 210, "20231231": 300, "20240331": 80, "20240630": 170, "20240930": 310}
    got = {r.report_date: r.net_profit_ttm for r in ttm.ttm(spark.createDataFrame(_periods(values), FIN)).collect()}
    assert len(got) == 7 and got["20240930"] == 310 + 300 - 210 and got["20231231"] == 300
    gap = {r.report_date for r in ttm.ttm(spark.createDataFrame(_periods(values, {"20230630"}), FIN)).collect()}
    assert "20240630" not in gap and {"20240930", "20240331"} <= gap
    twice = _periods(values) + [("income", "1", "20240930", "20241115", None, 999.0, None, None, None)]
    rows = spark.createDataFrame(twice[::-1], FIN)
    assert {r.report_date: (r.net_profit_ttm, r.pub_date) for r in ttm.ttm(rows).collect()}["20240930"] == (999 + 300 - 210, "20241115")


def test_asof_sees_the_same_day_and_never_ahead(spark):
    left = spark.createDataFrame([("a", date(2024, 1, d), d) for d in (1, 2, 3, 4)] + [("b", date(2024, 1, 1), 0)], "symbol string, date date, x int")
    right = spark.createDataFrame([("a", date(2024, 1, 2), 1.0), ("a", date(2024, 1, 4), None), ("a", None, 9.0)], "symbol string, eff date, v double")
    inner = asof_join(left, Right(right, "eff", ["v"]))
    assert {(r.date.day, r.v) for r in inner.collect()} == {(2, 1.0), (3, 1.0), (4, None)}
    kept = asof_join(left, Right(right, "eff", ["v"], "left"))
    assert kept.count() == 5 and kept.filter("symbol = 'b' AND v IS NULL").count() == 1


def test_valuation(spark):
    bars = spark.createDataFrame([("1", date(2024, 10, 29), 10.0, 1.0), ("1", date(2024, 10, 30), 10.0, 1.0), ("1", date(2024, 11, 15), 10.0, 2.0)], "symbol string, date date, close double, adj_factor double")
    capital = spark.createDataFrame([("1", date(2020, 1, 1), 100)], "symbol string, change_date date, total_shares long")
    twelve = spark.createDataFrame([("1", "20240930", "20241030", 100.0, 0.0, -5.0, None)], "symbol string, report_date string, pub_date string, net_profit_ttm double, deduct_net_profit_ttm double, revenue_ttm double, ocf_ttm double")
    equity = spark.createDataFrame([("balance", "1", "20240930", "20241030", "2024-10-01", 1000.0)], "source string, symbol string, report_date string, publish_date string, available_date string, net_assets double")
    got = sorted(tuple(r) for r in valuation.daily_valuation(bars, capital, twelve, equity).select("date", "close_hfq", "pe_ttm", "pe_deduct_ttm", "pb", "ps_ttm").collect())
    assert got == [(date(2024, 10, 30), 10.0, 10.0, None, 1.0, -200.0), (date(2024, 11, 15), 20.0, 10.0, None, 1.0, -200.0)]


def _panel(spark, closes, **more):
    rows = [("1", date(2024, 1, 1) + timedelta(days=k), float(c)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, close_hfq double").withColumns({k: F.lit(v) for k, v in more.items()})


def test_factors(spark):
    p = {"price_momentum_120d": {"lookback_days": 3}, "price_trend_gap_120d": {"trend_window": 3}}
    last = factors.calculate(_panel(spark, range(100, 110)), list(p), p).orderBy(F.desc("date")).first()
    assert last.price_momentum_120d == 109 / 106 - 1 and last.price_trend_gap_120d == 109 / 108 - 1 and last.listing_days == 10
    above = factors.calculate(_panel(spark, [1, 3, 2, 4]), ["price_trend_above_ma_120d"], {"price_trend_above_ma_120d": {"trend_window": 3}}).orderBy("date").collect()
    assert [r.price_trend_above_ma_120d for r in above] == [None, None, 0.0, 1.0]
    before = factors.calculate(_panel(spark, [*range(100, 109), 1]), list(p), p).orderBy("date").collect()[:-1]
    same = factors.calculate(_panel(spark, [*range(100, 109), 999]), list(p), p).orderBy("date").collect()[:-1]
    assert before == same  # no look-ahead
    with pytest.raises(ValueError):
        factors.calculate(_panel(spark, [1]), ["price_momentum_120d"], {"price_momentum_120d": {"lookback_days": 0}})
    assert factors.requirements(["price_volatility_60d", "valuation_pb"]) == (["close_hfq", "pb"], 61)


def test_cross_section(spark):
    df = spark.createDataFrame([("a", "d", 1.0), ("b", "d", 2.0), ("c", "d", 100.0), ("e", "d", None)], "symbol string, date string, x double")
    values = lambda c: [r[1] for r in sorted(df.select("symbol", c).collect())]
    up, down = (values(X.pct_rank("x", asc)) for asc in (True, False))
    assert up == [1 / 3, 2 / 3, 1.0, None] and down == [1.0, 2 / 3, 1 / 3, None]
    assert values(X.winsorize("x", 0, 0.5)) == [1.0, 2.0, 2.0, None]
    with pytest.raises(ValueError):
        X.combine({"x": 0.0})


def test_strategy_parameters_and_targets(spark):
    assert sum(strategies.normalized_weights({"valuation_pb": 1}).values()) == pytest.approx(1)
    for bad in ({"holding_count": 0}, {"nothing": 1}, {"trend_window": True}):
        with pytest.raises(ValueError):
            strategies.momentum_targets(_panel(spark, [1]), "2024-01-01", bad)
    good = spark.createDataFrame([(date(2024, 1, 31), "a", 1.0, 1, 0.5), (date(2024, 1, 31), "b", 0.5, 2, 0.5)], "date date, symbol string, score double, rank int, target_weight double")
    assert strategies.check_targets(good).count() == 2
    with pytest.raises(ValueError):
        strategies.check_targets(good.withColumn("target_weight", F.lit(0.6)))
    rows = [(s, date(2023, 1, 2) + timedelta(days=k), 100.0 + k * (i + 1)) for i, s in enumerate("abcde") for k in range(90)]
    out = strategies.momentum_targets(spark.createDataFrame(rows, "symbol string, date date, close_hfq double"), "2023-02-01", {"holding_count": 2, "lookback_days": 20, "trend_window": 20, "min_listing_days": 25})
    assert {(r.symbol, r.target_weight) for r in out.collect()} == {("e", 0.5), ("d", 0.5)}


def test_upserts_and_adjustment(spark, tmp_path):
    old = spark.createDataFrame([("1", date(2024, 1, 1), 1.0), ("1", date(2024, 1, 2), 2.0)], "symbol string, date date, close double")
    new = spark.createDataFrame([("1", date(2024, 1, 2), 9.0), ("1", date(2024, 1, 3), 3.0)], "symbol string, date date, close double")
    assert sorted(r.close for r in keep_last(old, new, ["symbol", "date"]).collect()) == [1.0, 3.0, 9.0]
    raw = spark.createDataFrame([("1", date(2026, 8, 3), 1640.0), ("1", date(2026, 8, 4), 1615.0)], "symbol string, date date, close double")
    events = spark.createDataFrame([("1", date(2026, 8, 3), 2.0), ("1", date(2026, 8, 1), 7.0)], "symbol string, date date, hfq_factor double")
    assert [(r.adj_factor, r.close_hfq) for r in ingest.adjustment_from_events(raw, events).orderBy("date").collect()] == [(2.0, 3280.0), (2.0, 3230.0)]
    assert not ingest.write_dataset(old.limit(0), f"{tmp_path}/x") and ingest.write_dataset(old, f"{tmp_path}/x")
    assert scans.dataset(spark, f"{tmp_path}/x", "daily_kline").select("symbol", "close", "open").count() == 2
    with pytest.raises(ValueError):
        assert_unique(old.union(old), ["symbol", "date"])


def test_types_and_names(spark):
    df = spark.createDataFrame([("nan", "1.5", None), ("x", "bad", 2)], "publish_date string, `其中:a` string, a int")
    assert ingest.clean_names(df).columns == ["publish_date", "a"]
    assert [tuple(r) for r in ingest.enforce_types(df).collect()] == [("", 1.5, None), ("x", None, 2.0)]
    wide = scans.widest_schema([spark.createDataFrame([], s).schema for s in ("a string, b int, c decimal(5,2)", "a bigint, b float, c bigint")])
    assert [f.dataType.simpleString() for f in wide] == ["bigint", "float", "decimal(5,2)"]


def test_universe_and_planning(spark):
    stored = spark.createDataFrame([("1", "a", 1), ("2", "b", 0), ("3", "c", 1), ("4", "d", 0)], "symbol string, name string, is_active int")
    incoming = spark.createDataFrame([("1", "a"), ("2", "b"), ("5", "e")], "symbol string, name string")
    assert {r.symbol: (r.action, r.is_active) for r in universe.diff(stored, incoming).collect()} == {"1": ("none", 1), "2": ("restore", 1), "3": ("delist", 0), "4": ("none", 0), "5": ("insert", 1)}
    with pytest.raises(ValueError):
        universe.diff(stored, incoming.limit(0))
    marks = spark.createDataFrame([("1", date(2024, 1, 5)), ("2", date(1990, 1, 1)), ("3", date(2024, 1, 8))], "symbol string, mark date")
    assert {tuple(r) for r in planning.ranges(marks, F.lit("2024-01-08").cast("date")).collect()} == {("1", date(2024, 1, 6), date(2024, 1, 8)), ("2", date(1990, 1, 1), date(2024, 1, 8))}


def test_payloads(spark):
    raw = spark.createDataFrame([("1", "x", 'cb([{"listInfo":{"content":[{"title":"T","date":"2024-10-30","url":"/p"},{"title":"no date"}]}}])'), ("2", "x", '{"data":{"disclosures":[{"title":"A","subtitle":"B","date":"1730246400000","url":"https://u"}]}}')], "symbol string, source string, payload string")
    got = {tuple(r) for r in payloads.announcements(raw, "https://b").collect()}
    assert got == {("1", date(2024, 10, 30), "T", "https://b/p", "x"), ("2", date(2024, 10, 30), "AB", "https://u", "x")}


def test_metrics(spark):
    nav = spark.createDataFrame([("a", date(2024, 1, d), v) for d, v in ((1, 100.0), (2, 110.0), (3, 99.0))] + [("b", date(2024, 1, 1), None)], "run_id string, date date, nav double")
    got = {r.run_id: r for r in metrics.performance(nav).collect()}
    assert got["a"].total_return == pytest.approx(-0.01) and got["a"].max_drawdown == pytest.approx(-0.1) and got["a"].trading_days == 3
    assert got["b"].trading_days == 0 and got["b"].total_return is None


def test_upsert_stream_writes_only_what_it_touches(spark, tmp_path):
    from tidemark.streaming.incremental import upsert_stream

    schema = "symbol string, date date, close double, year int"
    into, source = f"{tmp_path}/table", f"{tmp_path}/in"
    day = lambda y: f"{y}-01-02"

    def arrive(rows):
        spark.createDataFrame([(s, d, c, int(d[:4])) for s, d, c in rows], "symbol string, date string, close double, year int").selectExpr("symbol", "cast(date as date) date", "close", "year").coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), into, ["symbol", "date"], "year", f"{tmp_path}/at").awaitTermination()

    arrive([("A", day(2000), 1.0), ("B", day(2000), 2.0), ("A", day(2001), 3.0)])
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "year=2000").glob("*.parquet")}
    arrive([("A", day(2001), 4.0), ("C", day(2001), 5.0), ("C", day(2002), 6.0)])
    assert kept == {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "year=2000").glob("*.parquet")}
    got = sorted((r.symbol, r.year, r.close) for r in spark.read.schema(schema).parquet(into).collect())
    assert got == [("A", 2000, 1.0), ("A", 2001, 4.0), ("B", 2000, 2.0), ("C", 2001, 5.0), ("C", 2002, 6.0)]


def test_contracts_raise(spark):
    from tidemark.plans import factors, portfolio, strategies

    panel = spark.sql("SELECT date'2020-01-02' date, 'A' symbol, 1.0D close_hfq UNION ALL SELECT date'2020-01-02', 'A', 2.0D")
    with pytest.raises(ValueError, match="lacks"):
        factors.calculate(panel.drop("close_hfq"), ["price_momentum_120d"])
    with pytest.raises(ValueError, match="no date"):
        factors.calculate(panel.withColumn("date", F.lit("2020")), ["price_momentum_120d"])
    with pytest.raises(ValueError, match="repeated"):
        factors.calculate(panel, ["price_momentum_120d"], check_rows=True)
    with pytest.raises(ValueError, match="repeated"):
        factors.check_result(panel.withColumnRenamed("close_hfq", "value"), "x")
    with pytest.raises(ValueError, match="lacks"):
        factors.check_result(panel, "x")
    targets = lambda *w: spark.createDataFrame([("r", "2020-01-02", s, x) for s, x in w], "run_id string, date string, symbol string, target_weight double").withColumn("date", F.to_date("date"))
    strategies.check_targets(targets(("A", 0.5), ("B", 0.5)), ("run_id", "date"))
    prices = spark.sql("SELECT date'2020-01-02' date, 'A' symbol, 1.0D open, 1.0D open_hfq, 1.0D close_hfq")
    config = portfolio.Config("2020-01-01", "2020-02-01")
    for bad in (targets(("A", 0.6), ("B", 0.6)), targets(("A", 0.1), ("A", 0.2)), targets(("A", 0.0)), targets(("A", None))):
        with pytest.raises(ValueError, match="not valid"):
            portfolio.evaluate(prices, bad, config)
    with pytest.raises(ValueError, match="no close"):
        portfolio.evaluate(prices.withColumn("close_hfq", F.lit(None).cast("double")), targets(("A", 1.0)), config)


def test_indicator_text_columns_stay_text(spark):
    from tidemark.plans import ingest

    row = spark.sql("SELECT '000001' `证券代码`, '年报' `报告类型`, 'CNY' `币种`, '1.5' `毛利率`, 'nan' `公告日期`, '000001' symbol")
    got = ingest.enforce_types(row, ingest.INDICATOR_TEXT).first()
    assert tuple(got) == ("000001", "年报", "CNY", 1.5, "", "000001")
