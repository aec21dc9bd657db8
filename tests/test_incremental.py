"""Stored tables that are kept up to date: what is read and written, and that the result is that of a full build."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark import incremental_queries, queries
from tidemark.operators.storage import cut
from tidemark.plans import planning, ttm, valuation
from tidemark.plans.rolling import Rolling
from tidemark.sources import bridge
from tidemark.sources.store import Layout, Marked, Store, only

SF = f"{DATA}/sf0.001"
BARS = "symbol string, date date, close double, adj_factor double"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def bars(spark, data):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), float(c), 1.0) for s, d, c in data], BARS)


LAYOUT = Layout("symbol STRING, date DATE, close DOUBLE, adj_factor DOUBLE", ("symbol", "date"), "date", 8)


def test_an_upsert_reads_and_writes_only_what_it_touches(spark, tmp_path):
    store = Marked(spark, str(tmp_path / "bars"), LAYOUT)
    old = [(f"{s:06d}", f"{y}-0{m}-01", s + y) for s in range(40) for y in (1999, 2000, 2001) for m in (1, 5)]
    assert store.upsert(bars(spark, old)) == len({p.rsplit("/", 1)[0] for p in files(store.path)})
    before = files(store.path)
    new = [("000007", "2001-05-01", -1), ("000007", "2001-06-01", -2), ("000007", "2002-01-01", -3)]
    placed = LAYOUT.placed(bars(spark, new))
    touched, levels = store.touched(placed)
    assert {r["_year"] for r in touched} == {2001, 2002} and len(touched) == 2 and levels == ["_year", "_bucket"]
    stored = store._stored().filter(only(touched, levels))
    own = [f for f in before if f"_year=2001/_bucket={touched[0]['_bucket']}/" in f]
    assert {f.removeprefix("file://") for f in stored.inputFiles()} >= set(own)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = stored.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.removeprefix("file://") for r in got} == set(own)
    assert store.upsert(bars(spark, new)) == 2
    after = files(store.path)
    assert {f: t for f, t in after.items() if f in before} == {f: t for f, t in before.items() if f not in own}
    want = {(s, d): float(c) for s, d, c in old} | {(s, d): float(c) for s, d, c in new}
    assert {(r.symbol, str(r.date)): r.close for r in store.read().collect()} == want
    assert {r.symbol: str(r.mark) for r in store.marks.read().collect()} == {f"{s:06d}": "2001-05-01" for s in range(40)} | {"000007": "2002-01-01"}
    once = rows(store.read())
    store.upsert(bars(spark, new))  # a batch that is repeated
    assert rows(store.read()) == once
    assert store.upsert(bars(spark, [])) == 0 and rows(store.read()) == once


def test_more_folders_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.store.NAMED", 2)
    store = Store(spark, str(tmp_path / "bars"), LAYOUT)
    old = [(f"{s:06d}", f"{y}-01-01", s) for s in range(20) for y in (1999, 2000)]
    store.upsert(bars(spark, old))
    store.upsert(bars(spark, [(s, d, c + 1) for s, d, c in old if d < "2000"]))
    assert {(r.symbol, str(r.date)): r.close for r in store.read().collect()} == {(s, d): c + float(d < "2000") for s, d, c in old}


def test_nulls_and_missing_columns_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"), Layout("symbol STRING, report_date STRING, value DOUBLE", ("symbol", "report_date"), "report_date", 4))
    store.upsert(spark.createDataFrame([("a", "20000331", 1.0, "x"), ("a", None, 2.0, "x"), (None, "bad", 3.0, "x")], "symbol string, report_date string, value double, more string"))
    store.upsert(spark.createDataFrame([("a", "20000331")], "symbol string, report_date string"))
    assert rows(store.read()) == sorted([("a", "20000331", None), ("a", None, 2.0), (None, "bad", 3.0)], key=repr)
    with pytest.raises(ValueError, match="lacks"):
        Layout("symbol STRING, date DATE", ("symbol",), "date")


def test_replaced_symbols_leave_no_folder_behind(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"), Layout("symbol STRING, report_date STRING, value DOUBLE", ("symbol", "report_date"), "report_date", 64))
    make = lambda *r: spark.createDataFrame(list(r), "symbol string, report_date string, value double")
    store.upsert(make(("a", "20000331", 1.0), ("a", "19990331", 1.0), ("b", "20000331", 2.0)))
    store.replace(make(("a", "20010331", 5.0), ("c", "20010331", 9.0)), make(("a", "", 0.0)))  # c is not named: left out
    assert rows(store.read()) == [("a", "20010331", 5.0), ("b", "20000331", 2.0)]
    store.replace(make(), make(("a", "", 0.0), ("b", "", 0.0)))
    assert rows(store.read()) == [] and not files(store.path)


def test_days_one_by_one_equal_the_whole_valuation(spark, tmp_path):
    rng = random.Random(4)
    day = lambda k: dt.date(2000, 1, 3) + dt.timedelta(days=k)
    px = spark.createDataFrame([(f"{s:06d}", day(k), rng.uniform(1, 9), 1.0) for s in range(6) for k in range(8) if rng.random() < 0.8], BARS)
    capital = spark.createDataFrame([(f"{s:06d}", day(k), rng.randint(1, 99)) for s in range(6) for k in (-3, 3, 6)], "symbol string, change_date date, total_shares long")
    figures = spark.createDataFrame([(f"{s:06d}", f"1999{q}", day(k).strftime("%Y%m%d"), *[rng.uniform(1, 9) if rng.random() < 0.7 else None for _ in range(4)]) for s in range(6) for q, k in (("0930", -9), ("1231", 3), ("0630", 3))], "symbol string, report_date string, pub_date string, net_profit_ttm double, deduct_net_profit_ttm double, revenue_ttm double, ocf_ttm double")
    filed = spark.createDataFrame([("balance", f"{s:06d}", f"1999{q}", day(k).strftime("%Y%m%d"), a, rng.uniform(1, 9)) for s in range(6) for q, k, a in (("0930", -5, None), ("1231", 4, str(day(5))), ("0331", 99, None))], "source string, symbol string, report_date string, publish_date string, available_date string, net_assets double")
    want = rows(valuation.daily_valuation(px, capital, figures, filed))
    rolling = Rolling(spark, str(tmp_path / "by-day"), 4)
    late = rolling.learn(capital, figures, filed)
    assert late.isEmpty()
    for k in range(-1, 8):
        rolling.advance(px, day(k))
    assert rows(rolling.values.read()) == want and rolling.as_of() == day(7)
    assert len(list(Path(rolling.root, "state").glob("as_of=*"))) == 1
    with pytest.raises(ValueError, match="valued already"):
        rolling.advance(px, day(3))
    # rows that become known late, for days before and after the mark
    second = Rolling(spark, str(tmp_path / "late"), 4)
    some = lambda df, yes: df.filter(F.col("symbol").isin("000001", "000004") == yes)
    second.learn(some(capital, False), figures, some(filed, False))
    second.advance(px, day(4))
    behind = second.learn(capital=some(capital, True), filings=some(filed, True))
    assert {r.symbol: r.since for r in behind.collect()} == {"000001": day(-5), "000004": day(-5)}
    second.revalue(px, behind)
    second.advance(px, day(7))
    assert rows(second.values.read()) == want


def test_an_advance_reads_no_history(spark, tmp_path):
    """Neither bars nor right sides of years before are opened."""
    filings = bridge.table(spark, SF, "filings").cache()
    rolling = Rolling(spark, str(tmp_path), 4)
    rolling.learn(bridge.table(spark, SF, "share_capital"), ttm.ttm(filings), filings)
    store = Store(spark, str(tmp_path / "bars"), Layout("symbol STRING, date DATE, close DOUBLE, adj_factor DOUBLE", ("symbol", "date"), "date", 4))
    store.upsert(bridge.table(spark, SF, "daily_kline"))
    rolling.advance(store.read(), dt.date(1999, 12, 31))
    for side in rolling.fresh(dt.date(1999, 12, 31), dt.date(2000, 3, 31)):
        opened = {r.f for r in side.df.select(F.input_file_name().alias("f")).distinct().collect()}
        assert all("_year=1999" in f or "_year=2000" in f for f in opened if f)
    filings.unpersist()


def test_refreshed_figures_equal_a_full_build_after_one_changed_filing(spark, tmp_path):
    source = cut(bridge.table(spark, SF, "filings").select(*ttm.FILINGS.columns))
    filings, figures = Store(spark, str(tmp_path / "filings"), ttm.FILINGS), Store(spark, str(tmp_path / "ttm"), ttm.FIGURES)
    filings.upsert(source)
    figures.upsert(ttm.ttm(filings.read()))
    full = rows(figures.read())
    assert full == rows(ttm.ttm(source).select(*ttm.FIGURES.columns))
    one = source.filter("source = 'income' AND symbol = '000004' AND report_date = '19981231'").withColumn("net_profit", F.col("net_profit") + 1000)
    assert one.count() == 1
    before = files(figures.path)
    filings.upsert(one)
    assert ttm.work_plan(filings.read(), figures.read()).filter("symbol = '000004'").isEmpty()  # its last period is the same
    assert ttm.refresh(filings, figures, ttm.work_plan(filings.read(), figures.read(), pending=one, quarters=1)) == 1
    assert rows(figures.read()) == rows(ttm.ttm(filings.read()).select(*ttm.FIGURES.columns)) != full
    kept = {f for f, t in files(figures.path).items() if before.get(f) == t}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in before} - {f.split("_bucket=")[1].split("/")[0] for f in kept}) == 1


def test_stored_marks_plan_the_next_run(spark, tmp_path):
    store = Marked(spark, str(tmp_path / "bars"), LAYOUT)
    store.upsert(bars(spark, [("a", "2000-01-05", 1), ("b", "2000-01-07", 1)]))
    assert rows(planning.ranges(store.marks.read(), F.lit("2000-01-07").cast("date"))) == [("a", dt.date(2000, 1, 6), dt.date(2000, 1, 7))]
    coming = bars(spark, [("a", "2000-01-05", 9), ("a", "2000-01-06", 1), ("b", "2000-01-07", 9), ("c", "2000-01-02", 1)])
    assert [(r[0], str(r[1])) for r in rows(planning.beyond_marks(coming, store.marks.read()))] == [("a", "2000-01-06"), ("c", "2000-01-02")]


def test_a_run_takes_up_what_is_pending_and_clears_it(spark, tmp_path):
    source = cut(bridge.table(spark, SF, "filings").select(*ttm.FILINGS.columns))
    filings, figures = Store(spark, str(tmp_path / "filings"), ttm.FILINGS), Store(spark, str(tmp_path / "ttm"), ttm.FIGURES)
    state = planning.SyncState.at(spark, str(tmp_path / "sync"))
    filings.upsert(source)
    figures.upsert(ttm.ttm(source).filter("symbol NOT IN ('000003', '000006')"))
    day, named = F.lit("2001-05-01"), spark.createDataFrame([("000006",), ("unknown",)], "symbol string")
    state.record(ttm.PENDING, named, day)
    state.record("bars", named, day)
    plan = ttm.run(filings, figures, state, quarters=1)
    assert rows(plan.select("symbol", "reason")) == [("000003", "stale"), ("000006", "pending")]
    assert rows(figures.read()) == rows(ttm.ttm(source).select(*ttm.FIGURES.columns))
    assert rows(state.known(ttm.PENDING).select("symbol")) == [("unknown",)]  # it has no filing; it stays pending
    assert rows(state.known("bars").select("symbol")) == [("000006",), ("unknown",)]
    assert ttm.run(filings, figures, state, quarters=1).isEmpty()
    assert ttm.run(filings, figures, state, force=True).count() == source.filter("source = 'income'").select("symbol").distinct().count()
    assert rows(state.due("bars", named, F.lit("2001-05-01").cast("date"))) == []
    assert rows(state.due("bars", named, F.lit("2001-05-02").cast("date"))) == [("000006",), ("unknown",)]


def test_pending_symbols_need_no_complete_quarters(spark):
    filed = spark.createDataFrame([(source, s, p) for s, periods in (("a", ["20001231", "20000930", "20000630", "20000331", "19991231"]), ("b", ["20001231", "19991231"]), ("c", ["20001231"])) for p in periods for source in (["income"] if s != "c" else ["cashflow"])], "source string, symbol string, report_date string")
    done = spark.createDataFrame([], "symbol string, report_date string")
    plan = lambda *pending, **more: rows(ttm.work_plan(filed, done, spark.createDataFrame([(p,) for p in pending], "symbol string"), **more).select("symbol", "reason"))
    assert plan() == [("a", "stale")] and plan("b", "c") == [("a", "stale"), ("b", "pending")] and plan("a") == [("a", "pending")]
    assert plan(force=True) == [("a", "forced"), ("b", "forced")]


def test_deleted_rows_and_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"), Layout("symbol STRING, report_date STRING, value DOUBLE", ("symbol", "report_date"), "report_date", 64))
    make = lambda *r: spark.createDataFrame(list(r), "symbol string, report_date string, value double")
    store.upsert(make(("a", "20000331", 1.0), ("a", "20000630", 1.0), ("b", "19990331", 2.0), ("b", None, 3.0)))
    store.delete(make(("a", "20000331", None), ("b", "19990331", None), ("b", None, None), ("z", "20000331", None)))
    assert rows(store.read()) == [("a", "20000630", 1.0)] and len({p.rsplit("/", 1)[0] for p in files(store.path)}) == 1
    assert store.delete(make()) == 0


@pytest.mark.parametrize("name", ["pruned_upsert", "stored_marks", "pruned_upsert_share_capital", "pruned_upsert_etf", "filings_one_write", "ttm_refreshed", "due_for_sync", "valuation_rolled", "valuation_learned_late"])
def test_queries_are_registered_with_sql(name):
    assert queries.QUERIES[name] is getattr(incremental_queries, name) and name in queries.ORACLE_SQL


def test_a_first_write_copies_nothing(spark, tmp_path, monkeypatch):
    """Neither what was cut already nor what overwrites nothing."""
    from tidemark.sources import store as module

    rows = module.cut(spark.createDataFrame([("a", dt.date(2000, 1, 1), 5), ("b", dt.date(2001, 1, 1), 6)], "symbol string, change_date date, total_shares long"))
    copies, own = [], module.cut
    monkeypatch.setattr(module, "cut", lambda *a, **k: copies.append(a) or own(*a, **k))
    one = Store(spark, f"{tmp_path}/s", Layout("change_date DATE, total_shares BIGINT, symbol STRING", ("symbol", "change_date"), "change_date", 2))
    assert one.upsert(rows) == 2 and not copies
    assert one.upsert(rows.filter("symbol = 'a'").withColumn("total_shares", F.lit(7))) == 1 and len(copies) == 2
    assert sorted(map(tuple, one.read().select("symbol", "total_shares").collect())) == [("a", 7), ("b", 6)] and rows.count() == 2
