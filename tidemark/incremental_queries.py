"""Queries of the parts that keep stored tables up to date; registered beside those of ``tidemark.queries``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.operators.storage import cut, shared_dir
from tidemark.plans import factors, filings, ingest, planning, ttm, valuation
from tidemark.plans.rolling import Rolling
from tidemark.queries import _FACTOR_SQL, _HFQ, _N, _TTM, _VAL, _VAL_COLS, _bars, _t, query
from tidemark.sources import buckets, scans
from tidemark.sources.store import Layout, Marked, Store

BARS = Layout(scans.SCHEMAS["daily_kline"], ("symbol", "date"), "date")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder: queries that change a table each have their own."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _third(rows: DataFrame) -> DataFrame:
    return rows.filter("cast(symbol AS int) % 10 = 3")


# --- upserts that rewrite what they touch ---------------------------------------------------------------------------


def _stored_bars(spark: SparkSession, sf_dir: str) -> Marked:
    """Bars before 2000, then a batch of some symbols from 1999 on."""
    store, bars = Marked(spark, _folder(spark, "bars"), BARS), cut(_t(spark, sf_dir, "daily_kline"))
    store.upsert(bars.filter("year(date) < 2000"))
    store.upsert(_third(bars).filter("year(date) >= 1999").withColumn("volume", F.col("volume") * 2))
    return store


@query("SELECT symbol, date, open, high, low, close, CASE WHEN CAST(symbol AS INT) % 10 = 3 AND year(date) >= 1999 THEN volume * 2 ELSE volume END AS volume, amount, adj_factor FROM daily_kline WHERE year(date) < 2000 OR CAST(symbol AS INT) % 10 = 3")
def pruned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_bars(spark, sf_dir).read()


@query("SELECT symbol, max(date) AS mark FROM daily_kline WHERE year(date) < 2000 OR CAST(symbol AS INT) % 10 = 3 GROUP BY symbol")
def stored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_bars(spark, sf_dir).marks.read()


@query("WITH m AS (SELECT symbol, max(date) AS mark FROM daily_kline WHERE year(date) < 2000 OR CAST(symbol AS INT) % 10 = 3 GROUP BY symbol) SELECT b.symbol, b.date, b.close FROM daily_kline b LEFT JOIN m USING (symbol) WHERE m.mark IS NULL OR b.date > m.mark")
def rows_beyond_stored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.beyond_marks(_t(spark, sf_dir, "daily_kline").select("symbol", "date", "close"), _stored_bars(spark, sf_dir).marks.read())


@query("SELECT symbol, change_date, CASE WHEN year(change_date) >= 2000 AND CAST(symbol AS INT) % 10 = 3 THEN total_shares + 5 ELSE total_shares END AS total_shares FROM share_capital")
def pruned_upsert_share_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "share_capital")
    store = Store(spark, _folder(spark, "capital"), Layout(scans.SCHEMAS["share_capital"], ("symbol", "change_date"), "change_date", 8))
    store.upsert(rows)
    store.upsert(_third(rows).filter("year(change_date) >= 2000").withColumn("total_shares", F.col("total_shares") + 5))
    return store.read()


@query("SELECT symbol, date, close, CASE WHEN year(date) >= 2000 THEN -1 ELSE CAST(floor(volume * 100) AS BIGINT) END AS volume FROM daily_kline WHERE CAST(symbol AS INT) % 10 = 3")
def pruned_upsert_etf(spark: SparkSession, sf_dir: str) -> DataFrame:
    etf = _third(_t(spark, sf_dir, "daily_kline")).withColumn("volume", F.floor(F.col("volume") * 100))
    store = Marked(spark, _folder(spark, "etf"), Layout(scans.SCHEMAS["etf_kline"], ("symbol", "date"), "date", 4))
    store.upsert(etf)
    store.upsert(etf.filter("year(date) >= 2000").withColumn("volume", F.lit(-1)))
    return store.read().select("symbol", "date", "close", "volume")


_TEXT = ("publish_date", "available_date")
_NUMBERS = ("revenue", "net_profit", "deduct_net_profit", "ocf", "net_assets", "roe_weighted", "operating_cashflow_to_revenue")


@query(f"""WITH typed AS (SELECT source, symbol, report_date, coalesce(publish_date, '') AS publish_date, coalesce(available_date, '') AS available_date, revenue, CASE WHEN report_date >= '19990101' AND CAST(symbol AS INT) % 10 = 3 THEN net_profit * 2 ELSE net_profit END AS net_profit,
  deduct_net_profit, ocf, net_assets, roe_weighted, operating_cashflow_to_revenue FROM filings), dated AS (SELECT *, {_N.format(x='publish_date')} AS p, {_N.format(x='available_date')} AS a FROM typed)
SELECT source, symbol, report_date, {", ".join(_NUMBERS)}, coalesce(min(p) OVER (PARTITION BY symbol, report_date), publish_date) AS publish_date, coalesce(max(greatest(p, a)) OVER (PARTITION BY symbol, report_date), available_date) AS available_date FROM dated""")
def filings_one_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four sources change in one job, whose folders are sources and buckets; dates of a period are reconciled over
    the sources on the way."""
    rows = cut(_t(spark, sf_dir, "filings"))
    store, tidy = Store(spark, _folder(spark, "filings"), ttm.FILINGS), lambda df: filings.reconcile(ingest.enforce_types(df))
    store.upsert(rows, tidy)
    store.upsert(_third(rows).filter("report_date >= '19990101'").withColumn("net_profit", F.col("net_profit") * 2), tidy)
    return store.read()


# --- trailing-twelve-month figures and valuations, kept up to date --------------------------------------------------


@query(f"{_TTM} SELECT symbol, report_date, pub_date, net_profit_ttm, deduct_net_profit_ttm, revenue_ttm, ocf_ttm FROM ttm_rows")
def ttm_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as they were before a correction and the last quarters of some symbols, their figures, and then what came;
    the stored state has the corrected symbols as pending, and the run computes what it plans."""
    return _ttm_run(spark, sf_dir)[0].read()


def _ttm_run(spark: SparkSession, sf_dir: str) -> tuple[Store, planning.SyncState]:
    rows = cut(_t(spark, sf_dir, "filings").select(*ttm.FILINGS.columns))
    stored, figures, state = Store(spark, _folder(spark, "filings"), ttm.FILINGS), Store(spark, _folder(spark, "ttm"), ttm.FIGURES), planning.SyncState.at(spark, _folder(spark, "sync"))
    ahead = (F.col("symbol").cast("int") % 10 == 3) & (F.col("report_date") >= "19990101")
    wrong = (F.col("symbol").cast("int") % 10 == 5) & (F.col("report_date") == "19970331") & (F.col("source") == "income")
    stored.upsert(rows.filter(~ahead).withColumn("net_profit", F.when(wrong, F.col("net_profit") / 2).otherwise(F.col("net_profit"))))
    figures.upsert(ttm.ttm(stored.read()))
    new = rows.filter(ahead | wrong)
    stored.upsert(new)
    state.record(ttm.PENDING, new.filter(wrong), F.lit("2001-12-31"))
    state.record("statements", new, F.lit("2001-12-31"))
    ttm.run(stored, figures, state, quarters=1)
    return figures, state


@query("""SELECT s.symbol, t.dataset FROM stored_stocks s, (VALUES ('statements'), ('ttm_pending')) AS t(dataset)
WHERE t.dataset = 'ttm_pending' OR NOT EXISTS (SELECT 1 FROM filings f WHERE f.symbol = s.symbol AND ((CAST(f.symbol AS INT) % 10 = 3 AND f.report_date >= '19990101') OR (CAST(f.symbol AS INT) % 10 = 5 AND f.report_date = '19970331' AND f.source = 'income')))""")
def due_for_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next run would take up: symbols whose statements were not stored on the last day; none is pending any more."""
    state, universe = _ttm_run(spark, sf_dir)[1], _t(spark, sf_dir, "stored_stocks")
    due = [state.due(d, universe, F.lit("2001-12-31").cast("date")).withColumn("dataset", F.lit(d)) for d in ("statements", ttm.PENDING)]
    return due[0].unionByName(due[1])


def _rolling(spark: SparkSession, sf_dir: str) -> tuple[Rolling, DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = cut(_t(spark, sf_dir, "filings"))
    return Rolling(spark, _folder(spark, "rolling")), cut(_t(spark, sf_dir, "daily_kline")), _t(spark, sf_dir, "share_capital"), cut(ttm.ttm(rows)), rows


@query(f"{_VAL} SELECT {_VAL_COLS} FROM val")
def valuation_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History first, then a quarter, a day, and the rest, each from what is remembered of the days before."""
    rolling, bars, capital, figures, rows = _rolling(spark, sf_dir)
    rolling.learn(capital, figures, rows)
    for day in (dt.date(1999, 12, 31), dt.date(2000, 4, 3), dt.date(2000, 4, 4), dt.date(2100, 1, 1)):
        rolling.advance(bars, day)
    return rolling.values.read()


@query(f"{_VAL} SELECT {_VAL_COLS} FROM val")
def valuation_learned_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some symbols' sides become known only after the days were valued."""
    rolling, bars, capital, figures, rows = _rolling(spark, sf_dir)
    late = lambda df: df.filter("cast(symbol AS int) % 10 = 3 OR (cast(symbol AS int) % 10 = 5)")
    rest = lambda df: df.filter("cast(symbol AS int) % 10 NOT IN (3, 5)")
    rolling.learn(rest(capital), rest(figures), rest(rows))
    rolling.advance(bars, dt.date(1999, 12, 31))
    rolling.revalue(bars, rolling.learn(late(capital), late(figures), late(rows)))
    rolling.advance(bars, dt.date(2100, 1, 1))
    return rolling.values.read()


# --- no shuffle, no task as long as a symbol, no job for a contract --------------------------------------------------

BUCKETS = 8


def _in_buckets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows, mark = cut(_t(spark, sf_dir, "filings")), uuid.uuid4().hex
    out = []
    for name, df, order in (("bars", _t(spark, sf_dir, "daily_kline"), "date"), ("capital", _t(spark, sf_dir, "share_capital"), "change_date"), ("figures", ttm.ttm(rows), "report_date"), ("filings", rows, "report_date")):
        buckets.write_bucketed(df, f"{name}_{mark}", BUCKETS, (order,))
        out.append(buckets.bucketed(spark, f"{name}_{mark}", BUCKETS))
    return out


@query(f"{_VAL} SELECT {_VAL_COLS} FROM val")
def valuation_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored buckets to the result without an exchange."""
    return valuation.daily_valuation(*_in_buckets(spark, sf_dir))


@query(f"{_VAL} SELECT symbol, date, volume, pb FROM (SELECT b.symbol, b.date, b.volume, v.pb FROM daily_kline b LEFT JOIN val v ON v.symbol = b.symbol AND v.date = b.date) WHERE symbol = '000003'")
def one_symbol_of_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of one symbol opens one bucket of each table."""
    tables = [df.filter("symbol = '000003'") for df in _in_buckets(spark, sf_dir)]
    values = valuation.daily_valuation(*tables).select("symbol", "date", "pb")
    return tables[0].select("symbol", "date", "volume").join(values, ["symbol", "date"], "left")


_PRICE = [n for n in _FACTOR_SQL if n.startswith("price")]
_PRICE_SQL = f"WITH {_HFQ}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS listing_days, close_hfq / lag(close_hfq) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM hfq) SELECT symbol, date, listing_days, {', '.join(f'round({_FACTOR_SQL[n]}, 8) AS {n}' for n in _PRICE)} FROM r"


def _rounded_factors(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", "date", F.col("listing_days").cast("long").alias("listing_days"), *(F.round(n, 8).alias(n) for n in _PRICE))


@query(_PRICE_SQL)
def factors_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of 400 sessions, so that each symbol is several tasks."""
    return _rounded_factors(factors.calculate_sliced(_bars(spark, sf_dir).select("symbol", "date", "close_hfq"), _PRICE, 400))


@query(_PRICE_SQL)
def factors_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's contract is checked by the write of its factors."""
    rows, watched = factors.calculate_watched(_bars(spark, sf_dir).select("symbol", "date", "close_hfq"), _PRICE)
    rows = cut(_rounded_factors(rows))
    watched.verify()
    return rows


# --- folders of files that disagree ---------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> str:
    """Bars of three times, each with columns and types of its own, in files of one folder."""
    path, bars = _folder(spark, "mixed"), cut(_t(spark, sf_dir, "daily_kline").select("symbol", "date", "volume", "close", "amount"))
    year = F.year("date")
    bars.filter(year < 1996).select("symbol", "date", F.floor("volume").cast("int").alias("volume"), "close").write.parquet(f"{path}/old")
    bars.filter((year >= 1996) & (year < 1999)).select("symbol", "date", "volume", F.col("amount").cast("string").alias("amount")).write.parquet(f"{path}/middle")
    bars.filter(year >= 1999).select("date", "close", F.floor("volume").alias("volume"), "amount", "symbol").write.parquet(f"{path}/new")
    return path


@query("""SELECT symbol, date, CASE WHEN year(date) BETWEEN 1996 AND 1998 THEN volume ELSE floor(volume) END AS volume, CASE WHEN year(date) BETWEEN 1996 AND 1998 THEN NULL ELSE close END AS close, CASE WHEN year(date) >= 1996 THEN amount END AS amount FROM daily_kline""")
def union_of_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.union_folder(spark, _mixed(spark, sf_dir)).select("symbol", "date", "volume", "close", "amount")


@query("""WITH n AS (SELECT count(*) FILTER (year(date) < 1996) AS a, count(*) FILTER (year(date) BETWEEN 1996 AND 1998) AS b, count(*) FILTER (year(date) >= 1999) AS c FROM daily_kline)
SELECT column_name, type, variants, rows FROM (SELECT unnest([
  {'column_name': 'symbol', 'type': 'string', 'variants': 3, 'rows': a + b + c}, {'column_name': 'date', 'type': 'date', 'variants': 3, 'rows': a + b + c}, {'column_name': 'volume', 'type': 'int', 'variants': 1, 'rows': a}, {'column_name': 'volume', 'type': 'double', 'variants': 1, 'rows': b},
  {'column_name': 'volume', 'type': 'bigint', 'variants': 1, 'rows': c}, {'column_name': 'close', 'type': 'double', 'variants': 2, 'rows': a + c}, {'column_name': 'amount', 'type': 'string', 'variants': 1, 'rows': b}, {'column_name': 'amount', 'type': 'double', 'variants': 1, 'rows': c}], recursive := true) FROM n)""")
def schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.schema_summary(spark, _mixed(spark, sf_dir))


@query("SELECT symbol, change_date, CASE WHEN year(change_date) >= 1998 THEN total_shares END AS total_shares FROM share_capital")
def declared_column_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one dataset, some without a declared column."""
    rows, path = _t(spark, sf_dir, "share_capital"), _folder(spark, "missing")
    rows.filter("year(change_date) < 1998").select("change_date", "symbol").write.parquet(f"{path}/part=old")
    rows.filter("year(change_date) >= 1998").write.parquet(f"{path}/part=new")
    return scans.dataset(spark, path, "share_capital")


# --- writers and names ----------------------------------------------------------------------------------------------


@query("SELECT symbol, change_date, total_shares FROM share_capital")
def empty_write_changes_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _t(spark, sf_dir, "share_capital"), _folder(spark, "unchanged")
    ingest.write_dataset(rows, path)
    ingest.write_dataset(rows.limit(0), path)
    return scans.dataset(spark, path, "share_capital")


@query("SELECT symbol, count(*) AS rows, 1 AS files, 0 AS out_of_order FROM daily_kline GROUP BY symbol")
def order_within_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rows lie in the files: each symbol in one of them, by date."""
    path = _folder(spark, "ordered")
    ingest.write_dataset(_t(spark, sf_dir, "daily_kline"), path)
    rows = scans.dataset(spark, path, "daily_kline").select("symbol", "date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return ingest.out_of_order(rows, "file", "at", "symbol", "date")


@query("SELECT symbol, report_date, revenue AS \"营业总收入\", net_profit AS \"归属于母公司所有者的净利润\", publish_date FROM filings WHERE source = 'income'")
def clean_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "filings").filter("source = 'income'")
    return ingest.clean_names(rows.select("symbol", "report_date", F.col("revenue").alias("其中:营业总收入"), F.col("net_profit").alias(" 加：归属于母公司所有者的净利润 "), "publish_date", F.lit(0.0).alias("减:营业总收入")))


_PLACES = "list_value({})".format(", ".join(f"'{p}'" for p in M.PROVINCES))
_ADDRESS = "CASE s_suppkey % 4 WHEN 0 THEN p || '省某市' || s_name WHEN 1 THEN s_name || '（' || p || '）' WHEN 2 THEN s_name || '(x)(' || p || ')' ELSE s_name END"


@query(f"WITH a AS (SELECT s_suppkey, s_name, {_PLACES}[s_suppkey % {len(M.PROVINCES)} + 1] AS p FROM supplier) SELECT s_suppkey, {_ADDRESS} AS address, CASE WHEN s_suppkey % 4 < 2 THEN p END AS province FROM a")
def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.element_at(F.array(*map(F.lit, M.PROVINCES)), (F.col("s_suppkey") % len(M.PROVINCES) + 1).cast("int")).alias("p"))
    return rows.select("s_suppkey", F.expr(_ADDRESS).alias("address")).withColumn("province", M.province(F.col("address")))
