"""The lake: datasets are written when they are asked for, and files follow the tasks, not the symbols."""

import glob

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.plans import ingest
from tidemark.queries import QUERIES
from tidemark.sources import bridge, lake

SF = f"{DATA}/sf0.001"


def test_share_capital_costs_no_folder_a_symbol_and_no_other_dataset(spark, monkeypatch):
    monkeypatch.setattr(lake, "_BUILT", {})
    monkeypatch.setattr(lake.bridge, "table", lambda s, d, name, own=bridge.table: own(s, d, name) if name == "share_capital" else 1 / 0)
    want = sorted(map(tuple, bridge.table(spark, SF, "share_capital").select("symbol", "change_date", "total_shares").collect()))
    got = lake.table(spark, SF, "share_capital").select("symbol", "change_date", "total_shares")
    assert sorted(map(tuple, got.collect())) == want
    path = lake.folder(spark, SF, "share_capital").removeprefix("file://")
    symbols = len({r[0] for r in want})
    assert not glob.glob(f"{path}/symbol=*") and len(glob.glob(f"{path}/*.parquet")) < symbols
    assert sorted(map(tuple, QUERIES["lake_single_symbols"](spark, SF).select("symbol", "change_date", "total_shares").collect())) == [r for r in want if r[0] in ("000003", "000007")]


def test_folders_a_symbol_are_written_by_more_tasks_if_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(lake, "_BUILT", {})
    monkeypatch.setattr(lake, "SYMBOLS_A_TASK", 2)
    got = QUERIES["lake_path_symbols"](spark, SF).select("symbol", "change_date", "total_shares")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lake.table(spark, SF, "share_capital").select("symbol", "change_date", "total_shares").collect()))
    path = lake.folder(spark, SF, "share_capital_by_symbol").removeprefix("file://")
    tasks = {f.rsplit("/", 1)[1].split("-")[1] for f in glob.glob(f"{path}/symbol=*/*.parquet")}
    assert len(tasks) > 1


def test_bars_are_those_of_the_sql_from_one_shuffle(spark):
    """Also where a day has lines of several times."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_shipdate", F.expr("l_shipdate + make_interval(0, 0, 0, 0, cast(l_orderkey % 3 AS int))")).withColumn("l_suppkey", F.col("l_suppkey") % 3)
    want = spark.sql(f"WITH li AS ({bridge.CTES['li']}) {bridge.CTES['daily_kline']}", lineitem=lines)
    got = bridge._bars(lines)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange ") == 1


def test_bars_move_only_the_lines_own_columns(spark):
    """Also of suppliers whose first six digits are those of others, and of lines without quantity, price or supplier."""
    odd = {"l_suppkey": "nullif(l_suppkey % 4, 3) + 1000000 * (l_orderkey % 2)", "l_quantity": "if(l_orderkey % 7 = 1, NULL, l_quantity)", "l_extendedprice": "if(l_orderkey % 11 = 1, NULL, l_extendedprice)"}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumns({k: F.expr(v) for k, v in odd.items()})
    want = spark.sql(f"WITH li AS ({bridge.CTES['li']}) {bridge.CTES['daily_kline']}", lineitem=lines)
    got = bridge._bars(lines)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    moved = bridge._bars(spark.read.parquet(f"{SF}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange ") == 1
    below = moved.split("Exchange ")[1].split("\n", 1)[1]  # what is read and made before the shuffle
    assert "FileScan" in below and not any(x in below for x in ("lpad", "decimal", " / "))


def test_a_write_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([("a", 1), ("b", 2)], 1).map(lambda r: seen.add(1) or r).toDF("symbol string, x int")
    assert ingest.write_dataset(rows, f"{tmp_path}/x") and seen.value == 2
    assert ingest.write_dataset(rows.filter("x > 1"), f"{tmp_path}/x") and spark.read.parquet(f"{tmp_path}/x").count() == 1
    assert not ingest.write_dataset(rows.limit(0), f"{tmp_path}/x") and not ingest.write_dataset(rows.limit(0), f"{tmp_path}/y", "symbol")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 1 and sorted(f.name for f in tmp_path.iterdir()) == ["x"]
    assert ingest.write_dataset(rows, f"{tmp_path}/y", "symbol") and ingest.write_dataset(rows.filter("x > 1").withColumn("x", F.lit(5)), f"{tmp_path}/y", "symbol")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/y").select("symbol", "x").collect())) == [("a", 1), ("b", 5)]
