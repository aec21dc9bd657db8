"""Market and filing tables derived from the star-schema tables that the tests and benchmarks read.

One line of SQL per table that Spark and DuckDB both run, so that oracle queries start from equal rows: a supplier is a
symbol, its lines of a day are a bar, and its quarters are filings of four sources with their own publish dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DAY = "CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS STRING)"
#: A filing's figures: name, and how it follows from a quarter.
_FIGURES = (("revenue", "revenue"), ("net_profit", "net_profit"), ("deduct_net_profit", "net_profit * 0.9"), ("ocf", "ocf"), ("net_assets", "net_assets"), ("roe_weighted", "net_profit / net_assets * 100"), ("operating_cashflow_to_revenue", "ocf / revenue"))
#: Filing sources: name, publish date, available date, and the figures that it has.
_SOURCES = (
    ("balance", _DAY.format(d="pub_balance"), "CASE WHEN k % 4 = 0 THEN CAST(NULL AS STRING) ELSE CAST(pub_balance + (k % 6) AS STRING) END", ("net_assets",)),
    ("income", _DAY.format(d="pub_income"), "CAST(NULL AS STRING)", ("revenue", "net_profit")),
    ("cashflow", _DAY.format(d="pub_cashflow"), "CASE WHEN k % 5 = 0 THEN 'invalid' END", ("ocf",)),
    ("indicator", "CAST(pub_indicator AS STRING) || ' 00:00:00'", "CAST(NULL AS STRING)", ("net_profit * 0.9", "net_profit / net_assets * 100", "ocf / revenue")),
)
CTES = {
    "li": """SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS px,
         CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt,
         CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax,
         row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rn,
         count(*) OVER (PARTITION BY l_suppkey, l_shipdate) AS n
  FROM {lineitem}""",
    "daily_kline": """SELECT symbol, date, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
         max(CASE WHEN rn = n THEN px END) AS close,
         CAST(sum(qty) AS DOUBLE) / 100 AS volume, CAST(sum(amt) AS DOUBLE) AS amount,
         1 + CAST(0.02 AS DOUBLE) * (year(date) - 1995) AS adj_factor
  FROM li GROUP BY symbol, date""",
    "share_capital": """SELECT symbol, min(date) AS change_date, CAST(sum(qty) AS BIGINT) * 10000 AS total_shares
  FROM li GROUP BY symbol, year(date)""",
    "q": """SELECT symbol, year(date) AS y, quarter(date) AS qn, sum(amt) AS rev,
         sum(amt * (CAST(0.06 AS DECIMAL(4,2)) - disc)) AS np, sum(amt * (CAST(0.05 AS DECIMAL(4,2)) - tax)) AS ocf
  FROM li GROUP BY symbol, year(date), quarter(date)""",
    "fin": """SELECT symbol, last_day(make_date(CAST(y AS INT), CAST(qn * 3 AS INT), 1)) AS period_end,
         CAST(CAST(symbol AS INT) + y * 4 + qn AS INT) AS k,
         CAST(sum(rev) OVER (PARTITION BY symbol, y ORDER BY qn) AS DOUBLE) AS revenue,
         CAST(sum(np)  OVER (PARTITION BY symbol, y ORDER BY qn) AS DOUBLE) AS net_profit,
         CAST(sum(ocf) OVER (PARTITION BY symbol, y ORDER BY qn) AS DOUBLE) AS ocf,
         1000000 + CAST(sum(np) OVER (PARTITION BY symbol ORDER BY y, qn) AS DOUBLE) AS net_assets
  FROM q""",
    "filed": """SELECT *, period_end + (20 + k % 15) AS pub_balance, period_end + (20 + (k * 3) % 40) AS pub_income,
         CASE WHEN k % 13 <> 0 THEN period_end + (20 + (k * 7) % 45) END AS pub_cashflow,
         period_end + (20 + (k * 11) % 60) AS pub_indicator,
         """ + _DAY.format(d="period_end") + """ AS report_date FROM fin""",
    "filings": " UNION ALL ".join(
        f"""SELECT '{source}' AS source, symbol, report_date, {text} AS publish_date, {available} AS available_date,
         {", ".join(f"{c if c in own else 'CAST(NULL AS DOUBLE)'} AS {n}" for n, c in _FIGURES)}
  FROM filed"""
        for source, text, available, own in _SOURCES
    ),
    "announcements": """SELECT symbol, report_date, pub_income - 3 + d AS publish_date,
         substr(report_date, 1, 4) || '年' || CASE substr(report_date, 5, 4) WHEN '0331' THEN '第一季度报告' WHEN '0630' THEN '半年度报告' WHEN '0930' THEN '第三季度报告' ELSE '年度报告' END || suffix AS title,
         'https://filings.test/' || symbol || '/' || report_date || '/' || CAST(d AS STRING) AS url, 'exchange' AS source
  FROM filed, (VALUES (0, ''), (-5, '摘要'), (4, ''), (9, '（修订版）')) AS kinds(d, suffix)""",
    "stored_stocks": """SELECT lpad(CAST(s_suppkey AS STRING), 6, '0') AS symbol, s_name AS name, CASE WHEN s_suppkey % 11 = 5 THEN 0 ELSE 1 END AS is_active
  FROM {supplier} WHERE s_suppkey % 5 <> 4""",
    "incoming_stocks": """SELECT lpad(CAST(s_suppkey AS STRING), 6, '0') AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' A' ELSE s_name END AS name
  FROM {supplier} WHERE s_suppkey % 7 <> 6""",
    "benchmark_bars": """SELECT '510300' AS symbol, date, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(volume * 100 AS DECIMAL(18,2))) AS DOUBLE) AS px
  FROM daily_kline WHERE day(date) % 9 <> 0 GROUP BY date""",
}


def sql_prefix(**tables: str) -> str:
    """``WITH`` all derived tables, over the named star-schema tables."""
    names = {"lineitem": "lineitem", "supplier": "supplier"} | tables
    return "WITH " + ",\n".join(f"{k} AS (\n  {v.format(**names)})" for k, v in CTES.items())


_USES = {"li": [], "daily_kline": ["li"], "share_capital": ["li"], "q": ["li"], "fin": ["li", "q"], "filed": ["li", "q", "fin"], "filings": ["li", "q", "fin", "filed"], "announcements": ["li", "q", "fin", "filed"], "stored_stocks": [], "incoming_stocks": [], "benchmark_bars": ["li", "daily_kline"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; scans read only the columns that it needs."""
    if name == "daily_kline":
        return _bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    if name == "filings":
        return _filings(table(spark, sf_dir, "filed"))
    own = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier") if any(f"{{{t}}}" in CTES[x] for x in [*_USES[name], name])}
    if "daily_kline" in _USES[name]:
        return spark.sql(CTES[name].replace("FROM daily_kline", "FROM {daily_kline}"), daily_kline=_bars(own["lineitem"]))
    ctes = [f"{k} AS ({CTES[k]})" for k in _USES[name]]
    return spark.sql((f"WITH {', '.join(ctes)} " if ctes else "") + CTES[name], **own)


def _bars(lines: DataFrame) -> DataFrame:
    """The rows of ``daily_kline``, whose windows and sums here share one shuffle, by the symbol. Only the lines' own columns
    are moved; what follows from them is made behind the shuffle."""
    symbol = "lpad(CAST(l_suppkey AS STRING), 6, '0')"
    rows = lines.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").repartition(F.expr(symbol))
    rows = rows.select(F.expr(symbol).alias("symbol"), *rows.columns)
    time = Window.partitionBy("l_suppkey", "l_shipdate", "symbol")  # the text last: rows are sorted by the numbers before it
    rank = F.row_number().over(time.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    made = {"date": F.col("l_shipdate").cast("date"), "px": F.expr("l_extendedprice / l_quantity"), "qty": F.expr("CAST(l_quantity AS DECIMAL(18,2))"), "amt": F.expr("CAST(l_extendedprice AS DECIMAL(18,2))")}
    li = rows.withColumns({"rn": rank, "n": F.count("*").over(time)}).select("symbol", *(c.alias(k) for k, c in made.items()), "rn", "n")
    return lines.sparkSession.sql(CTES["daily_kline"].replace("FROM li", "FROM {li}"), li=li)


def _filings(filed: DataFrame) -> DataFrame:
    """The rows of ``filings`` from one pass over ``filed``, which the union of the sources computes once for each."""

    def one(source: str, text: str, available: str, own: tuple[str, ...]) -> Column:
        figures = (F.expr(c if c in own else "CAST(NULL AS DOUBLE)").alias(n) for n, c in _FIGURES)
        return F.struct(F.lit(source).alias("source"), "symbol", "report_date", F.expr(text).alias("publish_date"), F.expr(available).alias("available_date"), *figures)

    return filed.select(F.inline(F.array(*(one(*s) for s in _SOURCES))))
