"""Feed payloads to rows: announcements, share histories, bars; one row of a raw table per payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.dedupe import first_by

_ITEM = "STRUCT<title: STRING, subtitle: STRING, date: STRING, url: STRING>"


def announcements(raw: DataFrame, base_url: str, body: str = "payload") -> DataFrame:
    """(symbol, publish_date, title, url, source) of raw (symbol, source, payload). A payload is a JSON list of pages, or one
    page, bare or wrapped in a callback; a page's items are in listInfo.content, data.content or data.disclosures, with
    their title in two fields. Items without a date go; relative urls are completed."""
    page = f"STRUCT<listInfo: STRUCT<content: ARRAY<{_ITEM}>>, data: STRUCT<content: ARRAY<{_ITEM}>, disclosures: ARRAY<{_ITEM}>>>"
    text = F.regexp_extract(F.col(body), r"(?s)^[^\[{]*?\(?\s*([\[{].*[\]}])\s*\)?\s*;?\s*$", 1)
    listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    pages = raw.withColumn("p", F.explode(F.from_json(listed, f"ARRAY<{page}>")))
    items = pages.select("symbol", "source", F.explode(F.concat(*(F.coalesce(F.col(c), F.array().cast(f"ARRAY<{_ITEM}>")) for c in ("p.listInfo.content", "p.data.content", "p.data.disclosures")))).alias("i"))
    number = F.col("i.date").try_cast("double")
    day = F.coalesce(F.when(number.isNotNull(), D.parse_number_date(number)), D.as_date(F.col("i.date")))
    url = F.when(F.col("i.url").rlike("^https?://"), F.col("i.url")).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(F.col("i.url"), F.lit("/"))))
    return items.select("symbol", day.alias("publish_date"), F.concat(F.coalesce("i.title", F.lit("")), F.coalesce("i.subtitle", F.lit(""))).alias("title"), url.alias("url"), "source").filter("publish_date IS NOT NULL")


def share_history(raw: DataFrame, body: str = "html") -> DataFrame:
    """(symbol, change_date, total_shares) of raw (symbol, html): rows of tables whose id starts with historyTable, with a
    date and a number of ten thousands of shares in their first two cells; of repeated dates the first row."""
    tables = F.regexp_extract_all(F.col(body), F.lit(r'(?s)<table[^>]*id="?historyTable[^>]*>(.*?)</table>'), 1)
    rows = raw.select("symbol", F.posexplode(F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)))).alias("k", "row"))
    cells = F.transform(F.regexp_extract_all(F.col("row"), F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    rows = rows.select("symbol", "k", cells.alias("c")).filter(F.size("c") >= 2)
    rows = rows.select("symbol", "k", F.try_to_date(F.regexp_extract(F.col("c")[0], r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd").alias("change_date"), F.regexp_extract(F.col("c")[1], r"([\d.]+)万股", 1).try_cast("double").alias("n"))
    rows = rows.filter("change_date IS NOT NULL AND n IS NOT NULL").withColumn("total_shares", F.rint(F.col("n") * 10000).cast("long"))
    return first_by(rows, ["symbol", "change_date"], F.asc("k")).select("symbol", "change_date", "total_shares")


def bars(raw: DataFrame, body: str = "payload", zone: str = "UTC") -> DataFrame:
    """Bars of raw (symbol, payload): an array of arrays that start with milliseconds, volume, open, high, low, close and
    have the amount at their tenth place; shorter ones go."""
    rows = raw.select("symbol", F.explode(F.from_json(F.col(body), "ARRAY<ARRAY<DOUBLE>>")).alias("b")).filter(F.size("b") >= 10)
    return rows.select("symbol", D.millis_to_date(F.col("b")[0], zone).alias("date"), *(F.col("b")[k].alias(n) for k, n in ((2, "open"), (3, "high"), (4, "low"), (5, "close"))), F.col("b")[1].cast("long").alias("volume"), F.col("b")[9].alias("amount"))
