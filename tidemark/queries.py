"""Every operator as a query over the driver's tables, with the same query in SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import market as M
from tidemark.operators import cross_section as X
from tidemark.operators.asof import Right, asof_join
from tidemark.operators.storage import shared_dir
from tidemark.plans import factors, filings, ingest, metrics, planning, portfolio, strategies, ttm, universe, valuation
from tidemark.sources import bridge, lake, payloads, scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

START, END = "1998-01-01", "2001-06-30"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` starts after the derived tables, with further CTEs or with SELECT."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body, recursive = sql.strip().removeprefix("RECURSIVE "), sql.strip().startswith("RECURSIVE ")
            whole = bridge.sql_prefix() + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
            ORACLE_SQL[f.__name__] = whole.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else whole
        return f

    return take


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the lake, which writes it when a session first asks for it; of the bridge if the lake has none of that name."""
    if name in ("daily_kline", "share_capital", "filings"):
        return lake.table(spark, sf_dir, name)
    return bridge.table(spark, sf_dir, name)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "daily_kline").withColumn("close_hfq", F.col("close") * F.col("adj_factor"))


_N = "CASE WHEN length(regexp_replace({x}, '\\D', '', 'g')) >= 8 AND try_strptime(left(regexp_replace({x}, '\\D', '', 'g'), 8), '%Y%m%d') IS NOT NULL THEN left(regexp_replace({x}, '\\D', '', 'g'), 8) END"
_D = "CAST(try_strptime(" + _N + ", '%Y%m%d') AS DATE)"
_DEADLINE = "CASE substr(report_date, 5) WHEN '0331' THEN make_date(CAST(left(report_date, 4) AS INT), 4, 30) WHEN '0630' THEN make_date(CAST(left(report_date, 4) AS INT), 8, 31) WHEN '0930' THEN make_date(CAST(left(report_date, 4) AS INT), 10, 31) WHEN '1231' THEN make_date(CAST(left(report_date, 4) AS INT) + 1, 4, 30) END"
_CANON = f"WITH dated AS (SELECT *, {_N.format(x='publish_date')} AS p, {_N.format(x='available_date')} AS a FROM filings), canon AS (SELECT symbol, report_date, min(p) AS publish, max(greatest(p, a)) AS available FROM dated GROUP BY symbol, report_date)"
_OVERDUE = f"{_CANON}, late AS (SELECT symbol, report_date, CAST(strptime(publish, '%Y%m%d') AS DATE) AS publish, {_DEADLINE} AS deadline FROM canon), overdue AS (SELECT * FROM late WHERE publish > deadline AND publish <= DATE '2001-12-31')"
_OFFICIAL = f"""{_OVERDUE}, official AS (SELECT f.symbol, f.report_date, min({{'publish_date': a.publish_date, 'title': a.title, 'url': a.url}}) AS m FROM (SELECT DISTINCT symbol, report_date FROM overdue) f JOIN announcements a ON a.symbol = f.symbol
  WHERE contains(a.title, left(f.report_date, 4)) AND NOT regexp_matches(a.title, '{"|".join(D.EXCLUDED_MARKERS)}')
    AND regexp_matches(a.title, CASE substr(f.report_date, 5) {" ".join(f"WHEN '{k}' THEN '{'(^|[^半])' if t == 'annual' else ''}({'|'.join(D.TITLE_MARKERS[t])})'" for k, t in D.REPORT_TYPES.items())} END)
  GROUP BY f.symbol, f.report_date)"""
_TTM = f"""WITH cur AS (SELECT symbol, report_date, max({_N.format(x='publish_date')}) AS pub_date, max(net_profit) FILTER (source = 'income') AS net_profit, max(revenue) FILTER (source = 'income') AS revenue,
    max(ocf) FILTER (source = 'cashflow') AS ocf, max(deduct_net_profit) FILTER (source = 'indicator') AS deduct_net_profit FROM filings WHERE source <> 'balance' GROUP BY symbol, report_date),
ttm AS (SELECT c.symbol, c.report_date, c.pub_date, {", ".join(f"c.{m} + (e.{m} - s.{m}) AS {m}_ttm" for m in ("net_profit", "deduct_net_profit", "revenue", "ocf"))} FROM cur c
  LEFT JOIN cur e ON e.symbol = c.symbol AND e.report_date = CAST(CAST(left(c.report_date, 4) AS INT) - 1 AS VARCHAR) || '1231'
  LEFT JOIN cur s ON s.symbol = c.symbol AND s.report_date = CAST(CAST(left(c.report_date, 4) AS INT) - 1 AS VARCHAR) || substr(c.report_date, 5)),
ttm_rows AS (SELECT * FROM ttm WHERE coalesce(net_profit_ttm, deduct_net_profit_ttm, revenue_ttm, ocf_ttm) IS NOT NULL)"""
_VAL = f"""{_TTM}, ttm_side AS (SELECT *, {_D.format(x='pub_date')} AS eff FROM ttm_rows QUALIFY row_number() OVER (PARTITION BY symbol, eff ORDER BY report_date DESC) = 1),
equity AS (SELECT symbol, report_date, net_assets, coalesce({_D.format(x='available_date')}, {_D.format(x='publish_date')}) AS eff FROM filings WHERE source = 'balance' QUALIFY row_number() OVER (PARTITION BY symbol, eff ORDER BY report_date DESC) = 1),
val AS (SELECT b.date, b.symbol, b.close AS raw_close, b.close * b.adj_factor AS close_hfq, c.total_shares, b.close * c.total_shares AS market_cap,
    b.close * c.total_shares / nullif(t.net_profit_ttm, 0) AS pe_ttm, b.close * c.total_shares / nullif(t.deduct_net_profit_ttm, 0) AS pe_deduct_ttm, b.close * c.total_shares / nullif(e.net_assets, 0) AS pb,
    b.close * c.total_shares / nullif(t.revenue_ttm, 0) AS ps_ttm, b.close * c.total_shares / nullif(t.ocf_ttm, 0) AS pcf_ttm, b.open, b.high, b.volume
  FROM daily_kline b ASOF JOIN share_capital c ON b.symbol = c.symbol AND b.date >= c.change_date
  ASOF JOIN (SELECT * FROM ttm_side WHERE eff IS NOT NULL) t ON b.symbol = t.symbol AND b.date >= t.eff
  ASOF JOIN (SELECT * FROM equity WHERE eff IS NOT NULL) e ON b.symbol = e.symbol AND b.date >= e.eff)"""
_VAL_COLS = "date, symbol, raw_close, close_hfq, total_shares, market_cap, pe_ttm, pe_deduct_ttm, pb, ps_ttm, pcf_ttm"
_PANEL = f"""{_VAL}, ind AS (SELECT symbol, report_date, roe_weighted, operating_cashflow_to_revenue, coalesce({_D.format(x='available_date')}, {_D.format(x='publish_date')}) AS eff FROM filings WHERE source = 'indicator' QUALIFY row_number() OVER (PARTITION BY symbol, eff ORDER BY report_date DESC) = 1),
low AS (SELECT min(date) AS d FROM (SELECT DISTINCT date FROM daily_kline WHERE date < DATE '{START}' ORDER BY date DESC LIMIT 250)),
panel AS (SELECT v.*, v.open * v.close_hfq / nullif(v.raw_close, 0) AS open_hfq, i.roe_weighted, i.operating_cashflow_to_revenue
  FROM val v ASOF LEFT JOIN (SELECT * FROM ind WHERE eff IS NOT NULL) i ON v.symbol = i.symbol AND v.date >= i.eff WHERE v.date BETWEEN (SELECT d FROM low) AND DATE '{END}')"""
_HFQ = "hfq AS (SELECT *, close * adj_factor AS close_hfq FROM daily_kline)"
_W = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_MA = f"CASE WHEN count(close_hfq) {_W.format(n=119)} = 120 THEN avg(close_hfq) {_W.format(n=119)} END"
_MOM = "close_hfq / lag(close_hfq, 120) OVER (PARTITION BY symbol ORDER BY date) - 1"


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT symbol, date, open, high, low, close, volume, amount, adj_factor, close * adj_factor AS close_hfq FROM daily_kline")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir)


@query("SELECT source, symbol, report_date, publish_date, available_date, revenue, net_profit, deduct_net_profit, ocf, net_assets, roe_weighted, operating_cashflow_to_revenue FROM filings")
def filings_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "filings")


@query("SELECT symbol, date, volume, amount FROM (SELECT symbol, date, CAST(volume AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS amount FROM daily_kline WHERE year(date) < 1998 UNION ALL SELECT symbol, date, CAST(CAST(floor(volume * 100) AS BIGINT) AS DOUBLE), amount FROM daily_kline WHERE year(date) >= 1998)")
def schema_union_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _t(spark, sf_dir, "daily_kline")
    old = bars.filter("year(date) < 1998").select("symbol", "date", "volume")
    new = bars.filter("year(date) >= 1998").select("symbol", "date", F.floor(F.col("volume") * 100).alias("volume"), "amount")
    return scans.union_widened([old, new])


@query("SELECT date, close * adj_factor AS close_hfq FROM daily_kline WHERE symbol = '000003' AND date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'")
def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.benchmark_prices(_t(spark, sf_dir, "daily_kline"), "000003", "1998-01-01", "1999-12-31")


@query("SELECT symbol, name FROM stored_stocks WHERE is_active = 1")
def active_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.active(_t(spark, sf_dir, "stored_stocks"))


@query("SELECT CAST(min(date) AS DATE) AS start, count(*) AS sessions FROM (SELECT DISTINCT date FROM daily_kline WHERE date < DATE '1998-01-01' ORDER BY date DESC LIMIT 120)")
def lookback_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _t(spark, sf_dir, "daily_kline").select("date")
    start = F.lit(valuation.lookback_start(bars, "1998-01-01", 120)).cast("date")
    return bars.filter((F.col("date") >= start) & (F.col("date") < F.lit("1998-01-01").cast("date"))).agg(F.min("date").alias("start"), F.countDistinct("date").alias("sessions"))


@query("SELECT symbol, publish_date, title || '全文' AS title, 'https://filings.test/' || symbol || '/' || report_date || '/' || CAST(datediff('day', (SELECT min(publish_date) FROM announcements), publish_date) AS VARCHAR) AS url, source FROM announcements")
def announcement_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "announcements")
    first = rows.agg(F.min("publish_date")).first()[0]
    day = F.datediff("publish_date", F.lit(first))
    item = F.struct("title", F.lit("全文").alias("subtitle"), F.date_format("publish_date", "yyyy-MM-dd").alias("date"), F.concat(F.lit("/"), "symbol", F.lit("/"), "report_date", F.lit("/"), day.cast("string")).alias("url"))
    page = F.to_json(F.struct(F.struct(F.collect_list(item).alias("content")).alias("listInfo")))
    raw = rows.groupBy("symbol", "source").agg(F.concat(F.lit("callback("), page, F.lit(");")).alias("payload"))
    return payloads.announcements(raw, "https://filings.test")


@query("SELECT symbol, date, open, high, low, close, CAST(floor(volume) AS BIGINT) AS volume, amount FROM daily_kline")
def bar_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _t(spark, sf_dir, "daily_kline")
    none = F.lit(0.0)
    one = F.array(F.unix_millis(F.col("date").cast("timestamp")).cast("double"), F.floor("volume").cast("double"), "open", "high", "low", "close", none, none, none, "amount")
    raw = bars.groupBy("symbol", F.year("date").alias("y")).agg(F.to_json(F.collect_list(one)).alias("payload"))
    return payloads.bars(raw)


@query("SELECT symbol, change_date, CAST(total_shares AS BIGINT) AS total_shares FROM share_capital")
def share_history_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td> "), F.col("change_date").cast("string"), F.lit(" </td><td>"), (F.col("total_shares") / 10000).cast("decimal(20,2)").cast("string"), F.lit("万股</td></tr>"))
    raw = _t(spark, sf_dir, "share_capital").groupBy("symbol").agg(F.concat(F.lit("<table id='x'><tr><td>2000-01-01</td><td>1万股</td></tr></table><table class=\"a\" id=\"historyTable01\">"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return payloads.share_history(raw)


# --- the lake: writers, declared schemas, dictionaries, calendars ---------------------------------------------------


@query("SELECT symbol, date, open, high, low, close, volume, amount, adj_factor FROM daily_kline")
def lake_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.table(spark, sf_dir, "daily_kline")


@query("SELECT symbol, date, open, high, low, close, CAST(floor(volume * 100) AS BIGINT) AS volume, amount, adj_factor FROM daily_kline WHERE CAST(symbol AS INT) % 10 = 3")
def lake_etf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.table(spark, sf_dir, "etf_kline")


@query("SELECT symbol, change_date, total_shares FROM share_capital")
def lake_share_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.table(spark, sf_dir, "share_capital")


@query("SELECT symbol, change_date, total_shares FROM share_capital WHERE symbol IN ('000003', '000007')")
def lake_single_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.dataset(spark, lake.folder(spark, sf_dir, "share_capital"), "share_capital", ["000003", "000007"])


@query("SELECT symbol, change_date, total_shares FROM share_capital")
def lake_path_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.with_path_symbol(spark, [f"{lake.folder(spark, sf_dir, 'share_capital_by_symbol')}/*"], "change_date DATE, total_shares BIGINT")


@query("SELECT source, symbol, report_date, publish_date, available_date, revenue, net_profit, deduct_net_profit, ocf, net_assets, roe_weighted, operating_cashflow_to_revenue FROM filings")
def lake_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("source", "symbol", "report_date", "publish_date", "available_date", "revenue", "net_profit", "deduct_net_profit", "ocf", "net_assets", "roe_weighted", "operating_cashflow_to_revenue")
    return lake.table(spark, sf_dir, "filings").select(*cols)


def _statement(source: str, name: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lake.table(spark, sf_dir, name).select("symbol", "report_date", "publish_date", "available_date", column)

    run.__name__ = f"lake_{source}"
    query(f"SELECT symbol, report_date, publish_date, available_date, {column} FROM filings WHERE source = '{source}'")(run)


for _s, _n, _c in (("balance", "fin_balance_sheet", "net_assets"), ("income", "fin_income_statement", "net_profit"), ("cashflow", "fin_cashflow_statement", "ocf"), ("indicator", "fin_indicator", "roe_weighted")):
    _statement(_s, _n, _c)


@query(f"{_TTM} SELECT symbol, report_date, pub_date, net_profit_ttm, deduct_net_profit_ttm, revenue_ttm, ocf_ttm FROM ttm_rows")
def lake_ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.table(spark, sf_dir, "fin_ttm")


@query("SELECT DISTINCT date AS trade_date FROM daily_kline")
def lake_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.calendar(spark, lake.folder(spark, sf_dir, "calendar"))


@query("WITH c AS (SELECT DISTINCT date FROM daily_kline), d AS (SELECT DISTINCT change_date AS date FROM share_capital UNION SELECT date + 1 FROM c) SELECT d.date, c.date IS NOT NULL AS is_session, (SELECT max(date) FROM c WHERE date <= DATE '1999-06-17') AS latest FROM d LEFT JOIN c USING (date)")
def calendar_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = scans.calendar(spark, lake.folder(spark, sf_dir, "calendar"))
    dates = lake.table(spark, sf_dir, "share_capital").select(F.col("change_date").alias("date")).union(days.select(F.date_add("trade_date", 1))).distinct()
    latest = D.latest_session(days, F.lit("1999-06-18 15:29:00").cast("timestamp")).first()["session"]
    return D.is_session(dates, days).select("date", "is_session", F.lit(latest).alias("latest"))


@query("SELECT symbol, report_date, deduct_net_profit AS \"扣非净利润\", roe_weighted AS \"净资产收益率_加权\", operating_cashflow_to_revenue AS \"经营现金流/营业收入\" FROM filings WHERE source = 'indicator'")
def indicator_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = scans.indicator_names(spark, lake.folder(spark, sf_dir, "indicators"))
    own = {"deduct_net_profit": "DEDUCT_NET", "roe_weighted": "ROE_WEIGHTED", "operating_cashflow_to_revenue": "OCF_TO_REVENUE"}
    rows = lake.table(spark, sf_dir, "fin_indicator").select("symbol", "report_date", *(F.col(k).alias(v) for k, v in own.items()), F.lit(1).alias("OTHER"))
    return ingest.translate_indicators(rows, names)


_UPSERTED = """WITH typed AS (SELECT source, symbol, report_date, coalesce(publish_date, '') AS publish_date, coalesce(available_date, '') AS available_date, {value} FROM filings WHERE source {which})"""


@query(f"""{_UPSERTED.format(value="CASE WHEN report_date >= '19990101' THEN net_profit * 2 ELSE net_profit END AS net_profit", which="<> 'indicator'")}, dated AS (SELECT *, {_N.format(x='publish_date')} AS p, {_N.format(x='available_date')} AS a FROM typed)
SELECT source, symbol, report_date, net_profit, coalesce(min(p) OVER (PARTITION BY symbol, report_date), publish_date) AS publish_date, coalesce(max(greatest(p, a)) OVER (PARTITION BY symbol, report_date), available_date) AS available_date FROM dated""")
def statement_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lake.table(spark, sf_dir, "filings").filter("source <> 'indicator'").select("source", "symbol", "report_date", "publish_date", "available_date", "net_profit")
    new = rows.filter("report_date >= '19990101'").withColumn("net_profit", F.col("net_profit") * 2)
    return ingest.upsert_filings(rows.filter("report_date < '20000101'"), new)


@query("SELECT symbol, report_date, coalesce(publish_date, '') AS \"公告日期\", '' AS \"数据可用日期\", '人民币' AS \"币种\", CASE WHEN report_date >= '19990101' THEN roe_weighted + 1 ELSE roe_weighted END AS roe FROM filings WHERE source = 'indicator'")
def indicator_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lake.table(spark, sf_dir, "fin_indicator").select("symbol", "report_date", F.col("publish_date").alias("公告日期"), F.col("available_date").alias("数据可用日期"), F.lit("人民币").alias("币种"), F.col("roe_weighted").cast("string").alias("roe"), F.lit("indicator").alias("source"))
    new = rows.filter("report_date >= '19990101'").withColumn("roe", (F.col("roe").cast("double") + 1).cast("string"))
    return ingest.upsert_indicators(rows.filter("report_date < '20000101'"), new).drop("source")


@query("SELECT count(*) AS total, count(*) FILTER (is_active = 0) AS inactive FROM stored_stocks")
def universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.counts(_t(spark, sf_dir, "stored_stocks"))


@query("""SELECT symbol, date, floor(volume * 10000) / 100 AS lots, strftime(date, '%Y%m%d') AS plain, printf('%.2f%%', floor(close) / 400 * 100) AS pct, printf('%.2f', floor(close) / 4) AS num,
  strftime(CAST(date_trunc('quarter', date) AS DATE) - 1, '%Y%m%d') AS q1, strftime(CAST(date_trunc('quarter', CAST(date_trunc('quarter', date) AS DATE) - 1) AS DATE) - 1, '%Y%m%d') AS q2 FROM daily_kline""")
def display_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date")
    quarters = D.quarters_before(d, 4)
    cols = {"lots": ingest.lots(F.floor(F.col("volume") * 10000)), "plain": D.strip_dashes(d.cast("string")), "pct": M.percent(F.floor("close") / 400), "num": M.number(F.floor("close") / 4), "q1": quarters[0], "q2": quarters[1]}
    return lake.table(spark, sf_dir, "daily_kline").select("symbol", "date", *(c.alias(k) for k, c in cols.items()))


# --- types and dates -----------------------------------------------------------------------------------------------


@query("SELECT coalesce(symbol, '') AS symbol, coalesce(available_date, '') AS available_date, CASE WHEN publish_date LIKE '%5' OR publish_date IS NULL THEN '' ELSE publish_date END AS publish_date, try_cast(publish_date AS DOUBLE) AS number, net_profit FROM filings")
def enforce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "filings")
    rows = rows.select("symbol", "available_date", F.when(F.col("publish_date").like("%5"), "nan").otherwise(F.col("publish_date")).alias("publish_date"), F.col("publish_date").alias("number"), "net_profit")
    return ingest.enforce_types(rows)


@query(f"SELECT source, symbol, report_date, {_N.format(x='publish_date')} AS publish, {_N.format(x='available_date')} AS available, coalesce({_D.format(x='available_date')}, {_D.format(x='publish_date')}) AS effective FROM filings")
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = F.col("publish_date"), F.col("available_date")
    return _t(spark, sf_dir, "filings").select("source", "symbol", "report_date", D.normalize_date(p).alias("publish"), D.normalize_date(a).alias("available"), D.effective_date(a, p).alias("effective"))


@query(f"""SELECT DISTINCT report_date, CASE substr(report_date, 5) WHEN '0331' THEN 'q1' WHEN '0630' THEN 'semiannual' WHEN '0930' THEN 'q3' WHEN '1231' THEN 'annual' END AS type, {_DEADLINE} AS deadline,
  strftime(last_day(CAST(strptime(report_date, '%Y%m%d') AS DATE) - INTERVAL 3 MONTH), '%Y%m%d') AS previous, CAST(CAST(left(report_date, 4) AS INT) - 1 AS VARCHAR) || '1231' AS year_end, CAST(CAST(left(report_date, 4) AS INT) - 1 AS VARCHAR) || substr(report_date, 5) AS same FROM filings""")
def period_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("report_date")
    return _t(spark, sf_dir, "filings").select("report_date").distinct().select(r, D.report_type(r).alias("type"), D.deadline(r).alias("deadline"), D.previous_quarter(r).alias("previous"), D.prior_year_end(r).alias("year_end"), D.prior_year_same(r).alias("same"))


@query("""WITH codes AS (SELECT lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM supplier), m AS (SELECT DISTINCT code, CASE WHEN regexp_matches(code, '^[0-3]') THEN 'SZ' WHEN regexp_matches(code, '^(4|8|920)') THEN 'BJ' ELSE 'SH' END AS market FROM codes)
SELECT code, market, lower(market) || code AS prefixed, CASE WHEN regexp_matches(code, '^(15|16|18)') THEN 'SZ' ELSE 'SH' END || code AS etf, CASE WHEN regexp_matches(code, '^[48]') THEN '920' || right(code, 3) ELSE code END AS bse, code || '.' || market AS symbol FROM m""")
def market_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(M.pad_code(F.col("s_suppkey") * 7919 % 1000000).alias("code")).distinct()
    return rows.select(code, M.exchange(code).alias("market"), M.prefixed(code).alias("prefixed"), M.etf_symbol(code).alias("etf"), M.current_bse_code(code).alias("bse"), M.market_symbol(M.prefixed(code)).alias("symbol"))


# --- filing dates --------------------------------------------------------------------------------------------------


@query(f"""{_CANON} SELECT d.source, d.symbol, d.report_date, coalesce(c.publish, d.publish_date) AS publish_date, coalesce(c.available, d.available_date) AS available_date,
  (d.publish_date IS DISTINCT FROM coalesce(c.publish, d.publish_date) OR d.available_date IS DISTINCT FROM coalesce(c.available, d.available_date)) AS changed FROM dated d JOIN canon c USING (symbol, report_date)""")
def reconcile_publish_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.reconcile(_t(spark, sf_dir, "filings")).select("source", "symbol", "report_date", "publish_date", "available_date", "changed")


@query(f"""{_CANON} SELECT d.source, count(*) FILTER (d.publish_date IS DISTINCT FROM coalesce(c.publish, d.publish_date) OR d.available_date IS DISTINCT FROM coalesce(c.available, d.available_date)) AS changed, count(*) AS rows FROM dated d JOIN canon c USING (symbol, report_date) GROUP BY d.source""")
def reconciled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.changed_rows(filings.reconcile(_t(spark, sf_dir, "filings")))


def _overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.overdue(_t(spark, sf_dir, "filings"), F.lit("2001-12-31").cast("date"))


@query(f"{_OVERDUE} SELECT symbol, report_date, publish, deadline FROM overdue")
def overdue_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overdue(spark, sf_dir)


@query(f"{_OVERDUE} SELECT symbol, min(CAST(strptime(report_date, '%Y%m%d') AS DATE)) AS first, greatest(max(deadline), DATE '2001-12-31') AS last FROM overdue GROUP BY symbol")
def announcement_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.search_window(_overdue(spark, sf_dir), F.lit("2001-12-31").cast("date"))


@query(f"{_OFFICIAL} SELECT symbol, report_date, m.publish_date AS official, m.title AS title, m.url AS url FROM official")
def first_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.first_disclosures(_overdue(spark, sf_dir), _t(spark, sf_dir, "announcements"))


@query(f"{_OFFICIAL} SELECT symbol, report_date, publish, deadline FROM overdue o WHERE NOT EXISTS (SELECT 1 FROM official f WHERE f.symbol = o.symbol AND f.report_date = o.report_date AND CAST(f.symbol AS INT) % 2 = 0)")
def unresolved_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _overdue(spark, sf_dir)
    even = _t(spark, sf_dir, "announcements").filter("cast(symbol AS int) % 2 = 0")
    return filings.unresolved(late, filings.first_disclosures(late, even))


@query(f"""{_OFFICIAL}, met AS (SELECT d.*, strftime(o.m.publish_date, '%Y%m%d') AS official FROM dated d LEFT JOIN official o USING (symbol, report_date)),
fixed AS (SELECT *, coalesce(official, publish_date) AS p2, CASE WHEN official IS NOT NULL THEN greatest(a, official) ELSE available_date END AS a2 FROM met)
SELECT source, symbol, report_date, net_profit, p2 AS publish_date, a2 AS available_date, (p2 IS DISTINCT FROM publish_date OR a2 IS DISTINCT FROM available_date) AS changed FROM fixed""")
def official_dates_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = filings.first_disclosures(_overdue(spark, sf_dir), _t(spark, sf_dir, "announcements"))
    return filings.apply_official(_t(spark, sf_dir, "filings"), official).select("source", "symbol", "report_date", "net_profit", "publish_date", "available_date", "changed")


_WINDOWED = _OFFICIAL.replace("JOIN announcements a ON a.symbol = f.symbol", "JOIN (SELECT n.* FROM announcements n JOIN (SELECT symbol, min(CAST(strptime(report_date, '%Y%m%d') AS DATE)) AS lo, greatest(max(deadline), DATE '1996-06-30') AS hi FROM overdue GROUP BY symbol) w ON w.symbol = n.symbol AND n.publish_date BETWEEN w.lo AND w.hi) a ON a.symbol = f.symbol")


@query(f"""{_WINDOWED}, met AS (SELECT d.*, strftime(o.m.publish_date, '%Y%m%d') AS official FROM dated d LEFT JOIN official o USING (symbol, report_date)),
fixed AS (SELECT *, coalesce(official, publish_date) AS p2, CASE WHEN official IS NOT NULL THEN greatest(a, official) ELSE available_date END AS a2 FROM met)
SELECT source, symbol, report_date, p2 AS publish_date, a2 AS available_date, (p2 IS DISTINCT FROM publish_date OR a2 IS DISTINCT FROM available_date) AS changed FROM fixed""")
def official_dates_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _overdue(spark, sf_dir)
    official = filings.first_disclosures(late, _t(spark, sf_dir, "announcements"), filings.search_window(late, F.lit("1996-06-30").cast("date")))
    return filings.apply_official(_t(spark, sf_dir, "filings"), official).select("source", "symbol", "report_date", "publish_date", "available_date", "changed")


@query("SELECT symbol, report_date FROM filings WHERE source IN ('balance', 'income', 'cashflow') AND NOT (source = 'cashflow' AND publish_date IS NULL) GROUP BY symbol, report_date HAVING count(DISTINCT source) = 3")
def complete_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.complete_periods(_t(spark, sf_dir, "filings").filter("NOT (source = 'cashflow' AND publish_date IS NULL)"))


@query("SELECT DISTINCT s.symbol, v.source FROM stored_stocks s, (VALUES ('balance'), ('income'), ('cashflow'), ('indicator')) AS v(source) WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.symbol = s.symbol AND f.source = v.source AND NOT (CAST(f.symbol AS INT) % 6 = 1 AND f.source <> 'income'))")
def symbols_missing_any_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.missing_symbols(_t(spark, sf_dir, "stored_stocks"), _t(spark, sf_dir, "filings").filter("NOT (cast(symbol AS int) % 6 = 1 AND source <> 'income')"))


# --- TTM, valuation, panel -----------------------------------------------------------------------------------------


@query(f"{_TTM} SELECT symbol, report_date, pub_date, net_profit_ttm, deduct_net_profit_ttm, revenue_ttm, ocf_ttm FROM ttm_rows")
def ttm_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttm.ttm(_t(spark, sf_dir, "filings"))


@query(f"""{_TTM}, done AS (SELECT symbol, max(report_date) AS d FROM ttm_rows WHERE CAST(symbol AS INT) % 3 > 0 GROUP BY symbol), income AS (SELECT DISTINCT symbol, report_date FROM filings WHERE source = 'income'), last AS (SELECT symbol, max(report_date) AS last_period FROM income GROUP BY symbol),
plan AS (SELECT symbol, last_period, CASE WHEN CAST(symbol AS INT) % 10 = 1 THEN 'pending' WHEN d IS NULL OR last_period > d THEN 'stale' END AS reason FROM last LEFT JOIN done USING (symbol)),
need AS (SELECT symbol, strftime(last_day(CAST(strptime(last_period, '%Y%m%d') AS DATE) - to_months(3 * CAST(i AS INT))), '%Y%m%d') AS report_date FROM plan, range(5) AS t(i) WHERE reason = 'stale'),
whole AS (SELECT symbol FROM need JOIN income USING (symbol, report_date) GROUP BY symbol HAVING count(*) = 5)
SELECT symbol, last_period, reason FROM plan WHERE reason = 'pending' OR symbol IN (SELECT symbol FROM whole)""")
def ttm_work_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "filings")
    pending = rows.filter("cast(symbol AS int) % 10 = 1").select("symbol")
    return ttm.work_plan(rows, ttm.ttm(rows).filter("cast(symbol AS int) % 3 > 0"), pending)


@query("SELECT b.symbol, b.date, b.close, c.total_shares FROM daily_kline b ASOF JOIN (SELECT symbol, change_date + 40 AS change_date, total_shares FROM share_capital) c ON b.symbol = c.symbol AND b.date >= c.change_date")
def asof_capital_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    capital = _t(spark, sf_dir, "share_capital").withColumn("change_date", F.date_add("change_date", 40))
    return asof_join(_t(spark, sf_dir, "daily_kline").select("symbol", "date", "close"), Right(capital, "change_date", ["total_shares"]))


@query(f"""WITH ind AS (SELECT symbol, report_date, roe_weighted, operating_cashflow_to_revenue, coalesce({_D.format(x='available_date')}, {_D.format(x='publish_date')}) AS eff FROM filings WHERE source = 'indicator' QUALIFY row_number() OVER (PARTITION BY symbol, eff ORDER BY report_date DESC) = 1)
SELECT b.symbol, b.date, b.close, i.roe_weighted, i.operating_cashflow_to_revenue FROM daily_kline b ASOF LEFT JOIN ind i ON b.symbol = i.symbol AND b.date >= i.eff""")
def asof_indicator_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join(_t(spark, sf_dir, "daily_kline").select("symbol", "date", "close"), valuation.indicator_side(_t(spark, sf_dir, "filings")))


@query(f"{_VAL} SELECT {_VAL_COLS} FROM val")
def valuation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "filings")
    return valuation.daily_valuation(_t(spark, sf_dir, "daily_kline"), _t(spark, sf_dir, "share_capital"), ttm.ttm(rows), rows)


def _panel(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = _t(spark, sf_dir, "filings")
    return valuation.market_panel(_t(spark, sf_dir, "daily_kline"), _t(spark, sf_dir, "share_capital"), ttm.ttm(rows), rows, START, END, 250, extra)


@query(f"{_PANEL} SELECT {_VAL_COLS}, open, high, volume, open_hfq, roe_weighted, operating_cashflow_to_revenue FROM panel")
def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir, ("high", "volume"))


_PANEL_DAYS = f"{_VAL}, low AS (SELECT min(date) AS d FROM (SELECT DISTINCT date FROM daily_kline WHERE date < DATE '{START}' ORDER BY date DESC LIMIT 61))"


@query(f"{_PANEL_DAYS} SELECT date, symbol, close_hfq, pb, open FROM val WHERE date BETWEEN (SELECT d FROM low) AND DATE '{END}'")
def factor_driven_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility looks back 61 sessions, and neither factor needs an indicator or a bar column."""
    rows = _t(spark, sf_dir, "filings")
    names = ["price_volatility_60d", "valuation_pb"]
    panel = valuation.panel_for(_t(spark, sf_dir, "daily_kline"), _t(spark, sf_dir, "share_capital"), ttm.ttm(rows), rows, START, END, names)
    return factors.check_panel(panel, names).select("date", "symbol", "close_hfq", "pb", "open")


@query(f"WITH {_HFQ} SELECT date, symbol, round({_MOM}, 9) AS value FROM hfq")
def factor_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factors.calculate(_bars(spark, sf_dir).select("symbol", "date", "close_hfq"), ["price_momentum_120d"], check_rows=True)
    return factors.long_form(rows, "price_momentum_120d", check_rows=True).withColumn("value", F.round("value", 9))


# --- factors and transforms ----------------------------------------------------------------------------------------


def _factor(name: str, digits: int = 9) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = factors.calculate(_bars(spark, sf_dir).select("symbol", "date", "close_hfq"), [name])
        return rows.select("symbol", "date", F.round(name, digits).alias("value"))

    return run


def _factor_query(key: str, name: str, sql: str) -> None:
    f = _factor(name)
    f.__name__ = key
    query(f"WITH {_HFQ}, r AS (SELECT *, close_hfq / lag(close_hfq) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM hfq) SELECT symbol, date, round({sql}, 9) AS value FROM r")(f)


_factor_query("factor_momentum", "price_momentum_120d", _MOM)
_factor_query("factor_trend_gap", "price_trend_gap_120d", f"close_hfq / {_MA} - 1")
_factor_query("factor_above_ma", "price_trend_above_ma_120d", f"CASE WHEN {_MA} IS NOT NULL THEN CAST(close_hfq > {_MA} AS DOUBLE) END")
_factor_query("factor_volatility", "price_volatility_60d", f"CASE WHEN count(ret) {_W.format(n=59)} = 60 THEN stddev_samp(ret) {_W.format(n=59)} END")

_FACTOR_SQL = {
    "price_momentum_120d": _MOM,
    "price_trend_gap_120d": f"close_hfq / {_MA} - 1",
    "price_trend_above_ma_120d": f"CASE WHEN {_MA} IS NOT NULL THEN CAST(close_hfq > {_MA} AS DOUBLE) END",
    "price_volatility_60d": f"CASE WHEN count(ret) {_W.format(n=59)} = 60 THEN stddev_samp(ret) {_W.format(n=59)} END",
    "valuation_pe_ttm": "CASE WHEN pe_ttm > 0 THEN pe_ttm END",
    "valuation_pb": "CASE WHEN pb > 0 THEN pb END",
    "quality_roe_weighted": "roe_weighted",
    "quality_operating_cashflow_ratio": "operating_cashflow_to_revenue",
}
_FACTOR_PANEL = f"{_PANEL}, rets AS (SELECT *, close_hfq / lag(close_hfq) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS listing_days FROM panel), fpanel AS (SELECT date, symbol, listing_days, {', '.join(f'{v} AS {k}' for k, v in _FACTOR_SQL.items())} FROM rets)"


@query(f"{_FACTOR_PANEL} SELECT date, symbol, {', '.join(f'round({k}, 8) AS {k}' if k.startswith('price') else k for k in _FACTOR_SQL)} FROM fpanel")
def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(_FACTOR_SQL)
    return factors.calculate(_panel(spark, sf_dir), names).select("date", "symbol", *(F.round(n, 8).alias(n) if n.startswith("price") else n for n in names))


def _ranked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prices, so that there are ties, and nulls."""
    return _t(spark, sf_dir, "daily_kline").select("date", "symbol", F.when(F.col("volume") > 0.05, F.floor(F.col("close") / 100).cast("double")).alias("x"))


_X = "WITH x AS (SELECT date, symbol, CASE WHEN volume > 0.05 THEN CAST(floor(close / 100) AS DOUBLE) END AS x FROM daily_kline)"


@query(f"""{_X} SELECT date, symbol, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY x ASC NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(x) OVER (PARTITION BY date) END AS up,
  CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY x DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(x) OVER (PARTITION BY date) END AS down,
  CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY x DESC NULLS LAST, symbol) END AS ordinal FROM x""")
def pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_bars(spark, sf_dir).select("date", "symbol", X.pct_rank("x").alias("up"), X.pct_rank("x", False).alias("down"), X.ordinal_rank("x").cast("long").alias("ordinal"))


@query(f"{_X} SELECT date, symbol, CASE WHEN x IS NOT NULL THEN round(least(greatest(x, quantile_cont(x, 0.1) OVER (PARTITION BY date)), quantile_cont(x, 0.9) OVER (PARTITION BY date)), 8) END AS x FROM x")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_bars(spark, sf_dir).select("date", "symbol", F.round(X.winsorize("x", 0.1, 0.9), 8).alias("x"))


@query(f"{_X} SELECT date, symbol, CASE WHEN x IS NOT NULL THEN CASE WHEN stddev_pop(x) OVER (PARTITION BY date) = 0 THEN 0.0 ELSE round((x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_pop(x) OVER (PARTITION BY date), 0), 8) END END AS z FROM x")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_bars(spark, sf_dir).select("date", "symbol", F.round(X.zscore("x"), 8).alias("z"))


@query("SELECT date, symbol, close * 0.25 + CASE WHEN volume > 0.05 THEN volume END * 0.75 AS score FROM daily_kline")
def score_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "daily_kline").withColumn("v", F.when(F.col("volume") > 0.05, F.col("volume")))
    return rows.select("date", "symbol", X.combine({"close": 0.25, "v": 0.75}).alias("score"))


@query("SELECT max(date) AS date FROM daily_kline GROUP BY date_trunc('month', date)")
def month_end_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.month_ends(_t(spark, sf_dir, "daily_kline").select("date"))


# --- strategies ----------------------------------------------------------------------------------------------------

_ENDS = "ends AS (SELECT max(date) AS date FROM {p} GROUP BY date_trunc('month', date))"
_TARGETS = "SELECT date, symbol, round(score, 8) AS score, CAST(rank AS BIGINT) AS rank, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS target_weight FROM ranked WHERE rank <= {n}"


def _rounded(targets: DataFrame) -> DataFrame:
    return targets.select("date", "symbol", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"), "target_weight")


def _momentum(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    return strategies.momentum_targets(_bars(spark, sf_dir).select("date", "symbol", "close_hfq"), START, {"holding_count": n})


@query(f"""WITH {_HFQ}, {_ENDS.format(p="hfq")}, f AS (SELECT date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS listing_days, {_MOM} AS score, CASE WHEN {_MA} IS NOT NULL THEN close_hfq > {_MA} END AS above FROM hfq),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM f WHERE date IN (SELECT date FROM ends) AND date >= DATE '{START}' AND listing_days >= 250 AND score IS NOT NULL AND above) {_TARGETS.format(n=10)}""")
def targets_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_momentum(spark, sf_dir))


@query(f"""{_FACTOR_PANEL}, {_ENDS.format(p="fpanel")}, ok AS (SELECT *, valuation_pe_ttm AS pe, valuation_pb AS pb FROM fpanel WHERE date IN (SELECT date FROM ends) AND date >= DATE '{START}' AND listing_days >= 250 AND valuation_pe_ttm IS NOT NULL AND valuation_pb IS NOT NULL AND quality_roe_weighted > 0 AND quality_operating_cashflow_ratio > 0 AND price_trend_above_ma_120d > 0),
pct AS (SELECT *, {", ".join(f"(rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2) / count(*) OVER (PARTITION BY date) AS {c}_pct" for c in ("pe", "pb"))} FROM ok),
ranked AS (SELECT date, symbol, pe_pct + pb_pct AS score, row_number() OVER (PARTITION BY date ORDER BY pe_pct + pb_pct, symbol) AS rank FROM pct WHERE pe_pct <= 0.8 AND pb_pct <= 0.8) {_TARGETS.format(n=10)}""")
def targets_quality_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(strategies.quality_value_targets(_panel(spark, sf_dir), START, {"holding_count": 10, "min_roe": 0.0, "pe_pb_percentile": 0.8}))


_WEIGHTS = strategies.normalized_weights(None)
_DIRECTION = {n: "ASC" if factors.FACTORS[n].higher_is_better else "DESC" for n in _WEIGHTS}


@query(f"""{_FACTOR_PANEL}, {_ENDS.format(p="fpanel")}, ok AS (SELECT * FROM fpanel WHERE date IN (SELECT date FROM ends) AND date >= DATE '{START}' AND listing_days >= 250 AND {" AND ".join(f"{n} IS NOT NULL" for n in _WEIGHTS)}),
clipped AS (SELECT date, symbol, {", ".join(f"least(greatest({n}, quantile_cont({n}, 0.05) OVER (PARTITION BY date)), quantile_cont({n}, 0.95) OVER (PARTITION BY date)) AS {n}" for n in _WEIGHTS)} FROM ok),
ranks AS (SELECT date, symbol, {", ".join(f"(rank() OVER (PARTITION BY date ORDER BY {n} {_DIRECTION[n]}) + (count(*) OVER (PARTITION BY date, {n}) - 1) / 2) / count(*) OVER (PARTITION BY date) AS {n}" for n in _WEIGHTS)} FROM clipped),
scored AS (SELECT date, symbol, {" + ".join(f"{n} * {w!r}::DOUBLE" for n, w in _WEIGHTS.items())} AS score FROM ranks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM scored) {_TARGETS.format(n=10)}""")
def targets_multi_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(strategies.multi_factor_targets(_panel(spark, sf_dir), START, {"holding_count": 10}))


# --- portfolio -----------------------------------------------------------------------------------------------------

CONFIG = portfolio.Config(START, END, 1_000_000.0, 3.0, 5.0)


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select("date", "symbol", "open", (F.col("open") * F.col("adj_factor")).alias("open_hfq"), "close_hfq")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the five and the ten symbols of highest momentum."""
    run = lambda name, weight: F.struct(F.lit(name).alias("run_id"), "date", "symbol", weight.alias("target_weight"))
    runs = F.array_compact(F.array(F.when(F.col("rank") <= 5, run("top5", F.lit(0.2))), run("top10", F.col("target_weight"))))
    return _momentum(spark, sf_dir).select(F.inline(runs))


def _result(spark: SparkSession, sf_dir: str) -> portfolio.Result:
    return portfolio.evaluate(_prices(spark, sf_dir), _targets(spark, sf_dir), CONFIG)


@query(f"""WITH {_HFQ}, {_ENDS.format(p="hfq")}, f AS (SELECT date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS listing_days, {_MOM} AS score, CASE WHEN {_MA} IS NOT NULL THEN close_hfq > {_MA} END AS above FROM hfq),
signals AS (SELECT DISTINCT date FROM f WHERE date IN (SELECT date FROM ends) AND date >= DATE '{START}' AND listing_days >= 250 AND score IS NOT NULL AND above),
days AS (SELECT DISTINCT date FROM daily_kline WHERE date BETWEEN DATE '{START}' AND DATE '{END}')
SELECT s.date AS signal_date, min(d.date) AS exec_date FROM signals s JOIN days d ON d.date > s.date GROUP BY s.date""")
def next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = portfolio.sessions(_prices(spark, sf_dir), CONFIG)
    return portfolio.plans(_momentum(spark, sf_dir).withColumn("run_id", F.lit("a")), days).select("signal_date", "exec_date")


_MOMENTUM = f"""{_HFQ}, {_ENDS.format(p="hfq")}, f AS (SELECT date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS listing_days, {_MOM} AS score, CASE WHEN {_MA} IS NOT NULL THEN close_hfq > {_MA} END AS above FROM hfq),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM f WHERE date IN (SELECT date FROM ends) AND date >= DATE '{START}' AND listing_days >= 250 AND score IS NOT NULL AND above)"""
_PATH = "OVER (PARTITION BY run_id, exec_date, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"
_RATE = "0.0008::DOUBLE"
#: The whole evaluation: plans, what is executed (folded by recursion), paths of holdings, weights, levels, ledger, values.
_PF = f"""RECURSIVE WITH {_MOMENTUM},
targets AS (SELECT 'top5' AS run_id, date, symbol, 0.2::DOUBLE AS tw FROM ranked WHERE rank <= 5 UNION ALL SELECT 'top10', date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) FROM ranked WHERE rank <= 10),
px AS (SELECT date, symbol, open, open * adj_factor AS open_hfq, close * adj_factor AS close_hfq FROM daily_kline WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
days AS (SELECT DISTINCT date FROM px),
plan AS (SELECT run_id, max(signal_date) AS signal_date, exec_date FROM (SELECT s.run_id, s.date AS signal_date, min(d.date) AS exec_date FROM targets s JOIN days d ON d.date > s.date GROUP BY s.run_id, s.date) GROUP BY run_id, exec_date),
held AS (SELECT t.run_id, pl.exec_date, pl.signal_date, t.symbol, t.tw AS w, px.open, px.open_hfq FROM targets t JOIN plan pl ON pl.run_id = t.run_id AND pl.signal_date = t.date JOIN px ON px.date = pl.exec_date AND px.symbol = t.symbol WHERE px.open_hfq IS NOT NULL),
ends_of AS (SELECT symbol, max(date) AS last_date FROM px GROUP BY symbol),
bad AS (SELECT h.run_id, h.exec_date AS held_from, pl.exec_date AS met_on, string_agg(DISTINCT h.symbol, ',' ORDER BY h.symbol) AS symbols FROM held h JOIN plan pl ON pl.run_id = h.run_id AND pl.exec_date > h.exec_date JOIN ends_of l ON l.symbol = h.symbol AND l.last_date >= pl.exec_date
  LEFT JOIN px ON px.symbol = h.symbol AND px.date = pl.exec_date AND coalesce(px.open_hfq, 0) <> 0 WHERE h.w > 0 AND px.symbol IS NULL GROUP BY h.run_id, h.exec_date, pl.exec_date),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY exec_date) AS k FROM plan),
fold AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS exec_date, CAST(NULL AS DATE) AS signal_date, CAST(NULL AS DATE) AS before, CAST(NULL AS VARCHAR) AS blocked_by, CAST(NULL AS DATE) AS now FROM plan
  UNION ALL SELECT n.run_id, n.k, n.exec_date, n.signal_date, e.now, b.symbols, CASE WHEN b.symbols IS NULL THEN n.exec_date ELSE e.now END FROM fold e JOIN numbered n ON n.run_id = e.run_id AND n.k = e.k + 1 LEFT JOIN bad b ON b.run_id = n.run_id AND b.held_from = e.now AND b.met_on = n.exec_date),
done AS (SELECT run_id, exec_date, signal_date, before, blocked_by FROM fold WHERE k > 0),
ran AS (SELECT run_id, exec_date, signal_date, lead(exec_date) OVER (PARTITION BY run_id ORDER BY exec_date) AS until FROM done WHERE blocked_by IS NULL),
grid AS (SELECT h.run_id, h.exec_date, h.symbol, h.w, r.until, h.open_hfq AS entry, d.date, px.open_hfq AS o, px.close_hfq AS c, l.last_date, sk.run_id IS NOT NULL AS skip FROM held h JOIN ran r ON r.run_id = h.run_id AND r.exec_date = h.exec_date JOIN days d ON d.date >= h.exec_date AND (r.until IS NULL OR d.date <= r.until)
  LEFT JOIN px ON px.date = d.date AND px.symbol = h.symbol JOIN ends_of l ON l.symbol = h.symbol LEFT JOIN (SELECT run_id, exec_date FROM done WHERE blocked_by IS NOT NULL) sk ON sk.run_id = h.run_id AND sk.exec_date = d.date WHERE h.w > 0),
marked AS (SELECT *, CASE WHEN coalesce(c, 0) <> 0 AND (coalesce(o, 0) <> 0 OR date = last_date) THEN c END AS mark FROM grid),
carried AS (SELECT *, last_value(mark IGNORE NULLS) {_PATH.format(upto="1 PRECEDING")} AS prev, last_value(mark IGNORE NULLS) {_PATH.format(upto="CURRENT ROW")} AS cur FROM marked),
kept AS (SELECT *, exp(sum(CASE WHEN skip AND coalesce(o, 0) <> 0 AND prev <> 0 THEN ln(prev / o) ELSE 0 END) {_PATH.format(upto="CURRENT ROW")}) AS kept, coalesce(date = until, false) AS leaves FROM carried),
paths AS (SELECT run_id, exec_date, symbol, w, date, CASE WHEN NOT leaves THEN coalesce(cur, entry) / entry * kept END AS ratio, CASE WHEN leaves THEN last_date >= date ELSE last_date > date END AS live,
  CASE WHEN leaves THEN CASE WHEN last_date >= date THEN o ELSE prev END / entry * kept END AS exit_ratio, mark AS close_hfq, date = last_date AS ends FROM kept),
cash AS (SELECT run_id, exec_date, 1 - sum(w) AS cash FROM held GROUP BY run_id, exec_date),
growth AS (SELECT p.run_id, p.date AS exec_date, max(c.cash) + sum(p.w * p.exit_ratio) AS growth FROM paths p JOIN cash c ON c.run_id = p.run_id AND c.exec_date = p.exec_date WHERE p.exit_ratio IS NOT NULL GROUP BY p.run_id, p.date, p.exec_date),
old AS (SELECT run_id, date AS exec_date, symbol, w * exit_ratio AS v FROM paths WHERE exit_ratio IS NOT NULL AND live),
new AS (SELECT h.run_id, h.exec_date, h.symbol, h.w AS w_new FROM held h JOIN ran r ON r.run_id = h.run_id AND r.exec_date = h.exec_date AND r.signal_date = h.signal_date),
moved AS (SELECT m.run_id, m.exec_date, m.symbol, coalesce(m.w_new, 0) AS w_new, coalesce(m.v / g.growth, 0) AS w_old, g.growth FROM (SELECT * FROM new FULL JOIN old USING (run_id, exec_date, symbol)) m LEFT JOIN growth g ON g.run_id = m.run_id AND g.exec_date = m.exec_date),
turned AS (SELECT run_id, exec_date, sum(abs(w_new - w_old)) AS turnover, max(growth) AS growth FROM moved GROUP BY run_id, exec_date),
steps AS (SELECT r.run_id, r.exec_date, r.signal_date, coalesce(t.turnover, 0) AS turnover, coalesce(t.growth, 1) AS growth, coalesce(c.cash, 1) AS cash FROM ran r LEFT JOIN turned t ON t.run_id = r.run_id AND t.exec_date = r.exec_date LEFT JOIN cash c ON c.run_id = r.run_id AND c.exec_date = r.exec_date),
levels AS (SELECT *, after / (1 - {_RATE} * turnover) AS before FROM (SELECT *, 1000000.0::DOUBLE * exp(sum(ln(growth) + ln(1 - {_RATE} * turnover)) OVER (PARTITION BY run_id ORDER BY exec_date)) AS after FROM steps)),
ledger AS (SELECT m.run_id, m.exec_date AS date, l.signal_date, m.symbol, CASE WHEN m.w_new > m.w_old THEN 'BUY' ELSE 'SELL' END AS side, px.open AS raw_open, px.open_hfq AS adjusted_open, abs(m.w_new - m.w_old) * l.before AS notional, abs(m.w_new - m.w_old) * l.before * {_RATE} AS cost, 'monthly_rebalance' AS reason
    FROM moved m JOIN levels l ON l.run_id = m.run_id AND l.exec_date = m.exec_date JOIN px ON px.date = m.exec_date AND px.symbol = m.symbol WHERE m.w_new <> m.w_old
  UNION ALL SELECT run_id, exec_date, signal_date, blocked_by, 'SKIP_REBALANCE', NULL, NULL, 0, 0, 'held_symbol_missing_open' FROM done WHERE blocked_by IS NOT NULL
  UNION ALL SELECT p.run_id, p.date, NULL, p.symbol, 'DELIST', NULL, p.close_hfq, l.after * p.w * p.ratio, 0, 'delisted_liquidation' FROM paths p JOIN levels l ON l.run_id = p.run_id AND l.exec_date = p.exec_date WHERE p.ends AND p.ratio IS NOT NULL AND p.close_hfq IS NOT NULL),
sums AS (SELECT run_id, exec_date, date, sum(w * ratio) AS whole, sum(CASE WHEN live THEN w * ratio ELSE 0 END) AS living FROM paths WHERE ratio IS NOT NULL GROUP BY run_id, exec_date, date),
run_days AS (SELECT g.run_id, g.date, l.exec_date, l.after, l.cash FROM (SELECT r.run_id, d.date FROM (SELECT DISTINCT run_id FROM targets) r, days d) g ASOF LEFT JOIN levels l ON g.run_id = l.run_id AND g.date >= l.exec_date),
nav AS (SELECT n.run_id, n.date, coalesce(n.after * (n.cash + coalesce(s.whole, 0)), 1000000.0) AS nav, coalesce(n.after * coalesce(s.living, 0), 0.0) AS positions_value FROM run_days n LEFT JOIN sums s ON s.run_id = n.run_id AND s.exec_date = n.exec_date AND s.date = n.date)"""
_TURNOVER = "(SELECT n.run_id, coalesce(t.v, 0) / n.first AS turnover, coalesce(t.trade_count, 0) AS trade_count FROM (SELECT run_id, min_by(nav, date) AS first FROM nav GROUP BY run_id) n LEFT JOIN (SELECT run_id, sum(CASE WHEN side IN ('BUY', 'SELL') THEN notional ELSE 0 END) AS v, count(*) AS trade_count FROM ledger GROUP BY run_id) t USING (run_id))"


@query(f"{_PF} SELECT run_id, exec_date, signal_date, before, blocked_by FROM done")
def plan_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).executions.select("run_id", "exec_date", "signal_date", "before", "blocked_by")


@query(f"{_PF} SELECT run_id, exec_date, symbol, w, date, round(ratio, 8) AS ratio, live, round(exit_ratio, 8) AS exit_ratio FROM paths")
def holding_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).paths.select("run_id", "exec_date", "symbol", "w", "date", F.round("ratio", 8).alias("ratio"), "live", F.round("exit_ratio", 8).alias("exit_ratio"))


@query(f"{_PF} SELECT run_id, exec_date, round(turnover, 8) AS turnover, round(before, 3) AS before, round(after, 3) AS after FROM levels")
def turnover_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _result(spark, sf_dir)
    return r.levels.select("run_id", "exec_date", F.round("turnover", 8).alias("turnover"), F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))


@query(f"{_PF} SELECT run_id, date, signal_date, symbol, side, raw_open, adjusted_open, round(notional, 3) AS notional, round(cost, 4) AS cost, reason FROM ledger")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).trades.withColumns({"notional": F.round("notional", 3), "cost": F.round("cost", 4)})


@query(f"{_PF} SELECT run_id, date, round(nav, 3) AS nav, round(nav - positions_value, 3) + 0.0 AS cash, round(positions_value, 3) AS positions_value FROM nav")
def daily_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).daily_nav.select("run_id", "date", F.round("nav", 3).alias("nav"), (F.round("cash", 3) + F.lit(0.0)).alias("cash"), F.round("positions_value", 3).alias("positions_value"))


@query(f"{_PF} SELECT 'daily_nav' AS part, run_id, CAST(date AS VARCHAR) AS date, '' AS symbol, round(nav, 3) AS value FROM nav UNION ALL SELECT 'trades', run_id, CAST(date AS VARCHAR), symbol || ' ' || side, round(notional, 3) FROM ledger UNION ALL SELECT 'rebalance_targets', run_id, CAST(date AS VARCHAR), symbol, tw FROM targets")
def result_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation's values, targets and ledger, written as a result set and read back from its files."""
    r, path = _result(spark, sf_dir), f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    ingest.write_results(path, r.daily_nav, _targets(spark, sf_dir), r.trades, {"start": START, "end": END})
    r.release()
    read = lambda part, symbol, value: spark.read.csv(f"{path}/{part}", header=True).select(F.lit(part).alias("part"), "run_id", "date", symbol.alias("symbol"), value.alias("value"))
    number = lambda c: F.col(c).cast("double")
    parts = [read("daily_nav", F.lit(""), F.round(number("nav"), 3)), read("trades", F.concat_ws(" ", "symbol", "side"), F.round(number("notional"), 3)), read("rebalance_targets", F.col("symbol"), number("target_weight"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{_PF} SELECT run_id, round(turnover, 8) AS turnover, trade_count FROM {_TURNOVER}")
def run_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _result(spark, sf_dir)
    return metrics.turnover(r.daily_nav, r.trades).select("run_id", F.round("turnover", 8).alias("turnover"), "trade_count")


_BENCH = f"WITH days AS (SELECT DISTINCT date FROM daily_kline WHERE date BETWEEN DATE '{START}' AND DATE '{END}'), b AS (SELECT d.date, p.px FROM days d ASOF LEFT JOIN (SELECT date, px FROM benchmark_bars) p ON d.date >= p.date), nav AS (SELECT date, px / first_value(px IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 1000000.0::DOUBLE AS benchmark_nav FROM b)"


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _t(spark, sf_dir, "benchmark_bars").select("date", F.col("px").alias("close_hfq"))
    return portfolio.benchmark_nav(portfolio.sessions(_t(spark, sf_dir, "daily_kline"), CONFIG), prices, CONFIG)


@query(f"{_BENCH} SELECT date, benchmark_nav FROM nav")
def benchmark_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir)


@query(f"""{_BENCH}, r AS (SELECT date, benchmark_nav AS x, benchmark_nav / lag(benchmark_nav) OVER (ORDER BY date) - 1 AS r, benchmark_nav / max(benchmark_nav) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM nav WHERE benchmark_nav IS NOT NULL)
SELECT 'benchmark' AS run_id, round(max_by(x, date) / min_by(x, date) - 1, 9) AS total_return, round(pow(max_by(x, date) / min_by(x, date), 365.25 / greatest(datediff('day', min(date), max(date)), 1)) - 1, 8) AS annualized_return,
  round(stddev_pop(r) * sqrt(252), 8) AS annualized_volatility, round(avg(r) / stddev_pop(r) * sqrt(252), 8) AS sharpe_ratio, round(min(d), 9) AS max_drawdown, count(*) AS trading_days FROM r""")
def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.performance(_benchmark(spark, sf_dir).withColumn("run_id", F.lit("benchmark")), "benchmark_nav")
    return m.select("run_id", F.round("total_return", 9).alias("total_return"), *(F.round(c, 8).alias(c) for c in ("annualized_return", "annualized_volatility", "sharpe_ratio")), F.round("max_drawdown", 9).alias("max_drawdown"), "trading_days")


_METRICS = """SELECT run_id, max_by(x, date) / min_by(x, date) - 1 AS total_return, pow(max_by(x, date) / min_by(x, date), 365.25 / greatest(datediff('day', min(date), max(date)), 1)) - 1 AS annualized_return,
  stddev_pop(r) * sqrt(252) AS annualized_volatility, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe_ratio, min(d) AS max_drawdown, count(*) AS trading_days
  FROM (SELECT run_id, date, x, x / lag(x) OVER (PARTITION BY run_id ORDER BY date) - 1 AS r, x / max(x) OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM {source} WHERE x IS NOT NULL) GROUP BY run_id"""
_LINES = {"total_return": "printf('%.2f%%', {c} * 100)", "annualized_return": "printf('%.2f%%', {c} * 100)", "annualized_volatility": "printf('%.2f%%', {c} * 100)", "sharpe_ratio": "printf('%.2f', {c})", "max_drawdown": "printf('%.2f%%', {c} * 100)", "trading_days": "CAST({c} AS VARCHAR)"}
_CELL = "coalesce(CASE WHEN {c} IS NOT NULL THEN {x} END, '—')"


@query(f"""{_PF}, bench_days AS (SELECT d.date, b.px FROM days d ASOF LEFT JOIN (SELECT date, px FROM benchmark_bars) b ON d.date >= b.date), bench AS (SELECT 'top10' AS run_id, date, px / first_value(px IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 1000000.0::DOUBLE AS x FROM bench_days),
s AS ({_METRICS.format(source="(SELECT run_id, date, nav AS x FROM nav)")}), b AS ({_METRICS.format(source="bench")}), t AS (SELECT * FROM {_TURNOVER}),
lines AS (SELECT s.run_id, [CAST('| metric | strategy | benchmark |' AS VARCHAR), '|---|---:|---:|', {", ".join(f"'| {k} | ' || {_CELL.format(c=f's.{k}', x=v.format(c=f's.{k}'))} || ' | ' || {_CELL.format(c=f'b.{k}', x=v.format(c=f'b.{k}'))} || ' |'" for k, v in _LINES.items())},
  '', 'turnover (traded value over the first value): ' || printf('%.2f', t.turnover), 'trades: ' || CAST(t.trade_count AS VARCHAR)] AS texts FROM s LEFT JOIN b ON b.run_id = s.run_id LEFT JOIN t ON t.run_id = s.run_id)
SELECT run_id, CAST(i AS INT) AS line, texts[i + 1] AS text FROM lines, range(11) AS r(i)""")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _result(spark, sf_dir)
    bench = metrics.performance(_benchmark(spark, sf_dir).withColumn("run_id", F.lit("top10")), "benchmark_nav")
    return metrics.summary_table(metrics.performance(r.daily_nav), bench, metrics.turnover(r.daily_nav, r.trades))


# --- ingest, universe, planning ------------------------------------------------------------------------------------


@query("SELECT symbol, date, open, high, low, CASE WHEN year(date) = 2001 THEN close * 1.01::DOUBLE ELSE close END AS close, volume, amount, adj_factor FROM daily_kline WHERE NOT (year(date) = 2000 AND month(date) > 6)")
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _t(spark, sf_dir, "daily_kline").filter("NOT (year(date) = 2000 AND month(date) > 6)")
    new = bars.filter("year(date) = 2001").withColumn("close", F.col("close") * F.lit(1.01))
    return ingest.upsert_bars(bars.filter("NOT (year(date) = 2001 AND month(date) > 4)"), new)


@query("SELECT symbol, change_date, CASE WHEN year(change_date) >= 2000 THEN total_shares + 5 ELSE total_shares END AS total_shares FROM share_capital")
def upsert_share_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "share_capital")
    return ingest.upsert_share_capital(rows, rows.filter("year(change_date) >= 2000").withColumn("total_shares", F.col("total_shares") + 5)).select("symbol", "change_date", "total_shares")


_RAW = "date, symbol, close, CASE WHEN day(date) % 3 > 0 THEN close * adj_factor END AS hfq"


@query(f"WITH r AS (SELECT {_RAW} FROM daily_kline) SELECT symbol, date, close, coalesce(last_value(hfq / close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS adj_factor FROM r")
def adj_factor_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    return ingest.adjustment_factors(bars.select("symbol", "date", "close"), bars.filter("day(date) % 3 > 0").select("symbol", "date", "close_hfq"))


@query("WITH e AS (SELECT symbol, CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN min(date) ELSE min(date) - 1 END AS date, 2.5::DOUBLE AS f FROM daily_kline WHERE year(date) >= 1999 GROUP BY symbol), r AS (SELECT b.symbol, b.date, b.close, e.f FROM daily_kline b LEFT JOIN e USING (symbol, date)), c AS (SELECT symbol, date, close, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS adj_factor FROM r) SELECT symbol, date, close, adj_factor, close * adj_factor AS close_hfq FROM c WHERE date BETWEEN DATE '1998-06-01' AND DATE '2000-05-31'")
def adj_factor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _t(spark, sf_dir, "daily_kline").select("symbol", "date", "close")
    events = bars.filter("year(date) >= 1999").groupBy("symbol").agg(F.min("date").alias("d")).select("symbol", F.when(F.col("symbol").cast("int") % 2 == 0, F.col("d")).otherwise(F.date_sub("d", 1)).alias("date"), F.lit(2.5).alias("hfq_factor"))
    return ingest.adjustment_from_events(bars, events, "1998-06-01", "2000-05-31")


@query("""SELECT coalesce(s.symbol, i.symbol) AS symbol, CASE WHEN i.symbol IS NOT NULL THEN i.name ELSE s.name END AS name, CASE WHEN i.symbol IS NOT NULL THEN 1 ELSE 0 END AS is_active,
  CASE WHEN s.symbol IS NULL THEN 'insert' WHEN i.symbol IS NULL AND s.is_active = 1 THEN 'delist' WHEN i.symbol IS NULL THEN 'none' WHEN s.is_active = 0 THEN 'restore' WHEN s.name <> i.name THEN 'update' ELSE 'none' END AS action
  FROM stored_stocks s FULL JOIN incoming_stocks i ON s.symbol = i.symbol""")
def universe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.diff(_t(spark, sf_dir, "stored_stocks"), _t(spark, sf_dir, "incoming_stocks"))


@query("SELECT symbol, name, is_active FROM stored_stocks UNION ALL SELECT symbol, name, 0 FROM incoming_stocks i WHERE NOT EXISTS (SELECT 1 FROM stored_stocks s WHERE s.symbol = i.symbol)")
def delisted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _t(spark, sf_dir, "incoming_stocks").select(F.col("symbol").cast("int").cast("string").alias("code"), "name")
    return universe.merge_delisted(_t(spark, sf_dir, "stored_stocks"), lists, lists.withColumn("name", F.lit("other")))


@query("SELECT s.symbol, s.name, s.is_active, CASE WHEN s.is_active = 0 THEN m.d END AS last_trade_date FROM stored_stocks s LEFT JOIN (SELECT symbol, max(date) AS d FROM daily_kline GROUP BY symbol) m USING (symbol)")
def delisted_last_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.last_trade_dates(_t(spark, sf_dir, "stored_stocks"), _t(spark, sf_dir, "daily_kline"))


@query("SELECT symbol, strftime(min(date), '%Y%m%d') AS list_date FROM daily_kline GROUP BY symbol")
def listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.listing_dates(_t(spark, sf_dir, "daily_kline"))


@query("SELECT s.symbol, CASE WHEN s.is_active = 1 THEN s.name ELSE coalesce(i.name, 'unknown') END AS name, s.is_active FROM stored_stocks s LEFT JOIN incoming_stocks i USING (symbol)")
def metadata_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _t(spark, sf_dir, "stored_stocks").withColumn("name", F.when(F.col("is_active") == 1, F.col("name")).otherwise(" "))
    last = stored.select("symbol", F.lit("unknown").alias("name"))
    return universe.fill_metadata(stored, ["name"], _t(spark, sf_dir, "incoming_stocks"), last)


@query("SELECT s.symbol, coalesce(max(b.date), DATE '1990-01-01') AS mark FROM stored_stocks s LEFT JOIN (SELECT * FROM daily_kline WHERE CAST(symbol AS INT) % 4 > 0) b ON b.symbol = s.symbol GROUP BY s.symbol")
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.high_water_marks(_t(spark, sf_dir, "daily_kline").filter("cast(symbol AS int) % 4 > 0"), _t(spark, sf_dir, "stored_stocks"))


@query("WITH m AS (SELECT symbol, max(date) AS mark FROM daily_kline WHERE year(date) < 2000 GROUP BY symbol) SELECT b.symbol, b.date, b.close FROM daily_kline b LEFT JOIN m USING (symbol) WHERE m.mark IS NULL OR b.date > m.mark")
def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _t(spark, sf_dir, "daily_kline").select("symbol", "date", "close")
    return planning.beyond_marks(bars, planning.high_water_marks(bars.filter("year(date) < 2000")))


@query("WITH m AS (SELECT s.symbol, coalesce(max(b.date), DATE '1990-01-01') AS mark FROM stored_stocks s LEFT JOIN (SELECT * FROM daily_kline WHERE CAST(symbol AS INT) % 4 > 0) b ON b.symbol = s.symbol GROUP BY s.symbol), r AS (SELECT symbol, CASE WHEN mark = DATE '1990-01-01' THEN mark ELSE mark + 1 END AS start, DATE '2001-10-20' AS \"end\" FROM m) SELECT symbol, start, \"end\" FROM r WHERE start <= \"end\" AND CAST(symbol AS INT) % 9 <> 0")
def fetch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _t(spark, sf_dir, "stored_stocks")
    marks = planning.high_water_marks(_t(spark, sf_dir, "daily_kline").filter("cast(symbol AS int) % 4 > 0"), stored)
    return planning.ranges(marks, F.lit("2001-10-20").cast("date"), stored.filter("cast(symbol AS int) % 9 = 0"))


@query("""WITH kept AS (SELECT symbol, report_date FROM filings WHERE source = 'income' AND CAST(symbol AS INT) % 5 <> 2 AND NOT (CAST(symbol AS INT) % 7 = 1 AND report_date > '20010101')),
r AS (SELECT f.symbol, 'disclosed' AS reason FROM filings f WHERE f.source = 'cashflow' AND f.publish_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.symbol = f.symbol AND k.report_date = f.report_date)
  UNION SELECT s.symbol, 'orphan' FROM stored_stocks s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.symbol = s.symbol) AND s.is_active = 1)
SELECT symbol, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM r WHERE symbol IN (SELECT symbol FROM stored_stocks) GROUP BY symbol""")
def sync_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stocks = _t(spark, sf_dir, "filings"), _t(spark, sf_dir, "stored_stocks")
    kept = rows.filter("source = 'income' AND cast(symbol AS int) % 5 <> 2 AND NOT (cast(symbol AS int) % 7 = 1 AND report_date > '20010101')")
    disclosed = rows.filter("source = 'cashflow'").select("symbol", "report_date", F.col("publish_date").alias("actual_date"))
    out = planning.sync_targets(stocks.select("symbol"), disclosed, kept.select("symbol", "report_date"), incomplete=stocks.filter("is_active = 0"))
    return out.select("symbol", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT symbol FROM (SELECT symbol, max(date) AS d FROM daily_kline GROUP BY symbol) WHERE CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN DATE '2001-12-01' ELSE d END >= DATE '2001-11-01'")
def synced_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _t(spark, sf_dir, "daily_kline").groupBy(F.lit("bars").alias("dataset"), "symbol").agg(F.max("date").alias("last_sync_date"))
    new = state.filter("cast(symbol AS int) % 2 = 0").withColumn("last_sync_date", F.lit("2001-12-01").cast("date"))
    return planning.synced_since(planning.record_sync(state, new), "bars", F.lit("2001-11-01").cast("date"))
