"""Column functions on filing dates, report periods and trading sessions.

Report periods and publish dates are ``YYYYMMDD`` strings; text that is no date gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The exchanges' filing calendar by the month and day of a report period.
REPORT_TYPES = {"0331": "q1", "0630": "semiannual", "0930": "q3", "1231": "annual"}
DEADLINES = {"0331": (0, 4, 30), "0630": (0, 8, 31), "0930": (0, 10, 31), "1231": (1, 4, 30)}
# Titles of periodic reports, and marks of documents that are not the report itself.
TITLE_MARKERS = {"annual": ("年度报告", "年报"), "semiannual": ("半年度报告", "半年报"), "q1": ("第一季度报告", "一季度报告"), "q3": ("第三季度报告", "三季度报告")}
EXCLUDED_MARKERS = ("摘要", "英文", "更正", "修订", "修正", "补充", "取消", "提示性公告")


def _choose(key: Column, table: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, v).otherwise(out)
    return out


def normalize_date(text: Column) -> Column:
    """``YYYYMMDD`` of the first eight digits if they are a date, else null."""
    digits = F.substring(F.regexp_replace(text, r"\D", ""), 1, 8)
    return F.when((F.length(digits) == 8) & F.try_to_date(digits, "yyyyMMdd").isNotNull(), digits)


def as_date(text: Column) -> Column:
    """DATE of a ``YYYYMMDD``-like text, else null."""
    return F.try_to_date(normalize_date(text), "yyyyMMdd")


def effective_date(available: Column, publish: Column) -> Column:
    """When a fact may be known: its available date, else its publish date."""
    return F.coalesce(as_date(available), as_date(publish))


def parse_number_date(value: Column, zone: str = "Asia/Shanghai") -> Column:
    """DATE of a number: eight digits as a date, else epoch seconds, or milliseconds above 1e11, in ``zone``."""
    n = value.cast("double")
    whole = F.when(n == F.floor(n), F.floor(n).cast("string"))
    eight = F.when(F.length(whole) == 8, F.try_to_date(whole, "yyyyMMdd"))
    millis = F.when(n > 1e11, n).otherwise(n * 1000)
    return F.coalesce(eight, F.to_date(F.from_utc_timestamp(F.timestamp_millis(millis.cast("long")), zone)))


def millis_to_date(millis: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(millis.cast("long")), zone))


def month_day(report_date: Column) -> Column:
    return F.substring(report_date, 5, 4)


def report_type(report_date: Column) -> Column:
    return _choose(month_day(report_date), {k: F.lit(v) for k, v in REPORT_TYPES.items()})


def deadline(report_date: Column) -> Column:
    """Statutory disclosure deadline of a report period; null for other periods."""
    year = F.substring(report_date, 1, 4).try_cast("int")
    return _choose(month_day(report_date), {k: F.make_date(year + y, F.lit(m), F.lit(d)) for k, (y, m, d) in DEADLINES.items()})


def title_matches(title: Column, report_date: Column) -> Column:
    """Whether a title announces the report of the period: it names the year and the kind, and no excluded mark. An
    annual mark right after 半 belongs to a semiannual report and does not count."""
    kinds = {k: F.regexp_like(title, F.lit("|".join(f"(?<!半){m}" if t == "annual" else m for m in TITLE_MARKERS[t]))) for k, t in REPORT_TYPES.items()}
    other = F.regexp_like(title, F.lit("|".join(EXCLUDED_MARKERS)))
    return F.coalesce(F.contains(title, F.substring(report_date, 1, 4)) & _choose(month_day(report_date), kinds) & ~other, F.lit(False))


def previous_quarter(report_date: Column) -> Column:
    """The quarter end before; other periods unchanged."""
    year = F.substring(report_date, 1, 4)
    return F.coalesce(_choose(month_day(report_date), {"0331": F.concat((year.try_cast("int") - 1).cast("string"), F.lit("1231")), "0630": F.concat(year, F.lit("0331")), "0930": F.concat(year, F.lit("0630")), "1231": F.concat(year, F.lit("0930"))}), report_date)


def quarters_back(report_date: Column, n: int) -> Column:
    """Array of n quarter ends up to report_date, latest first."""
    day = F.try_to_date(report_date, "yyyyMMdd")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.last_day(F.add_months(day, -3 * i)), "yyyyMMdd"))


def quarters_before(today: Column, n: int = 4) -> Column:
    """Array of the last n quarter ends before today, latest first."""
    last = F.date_sub(F.trunc(today, "quarter"), 1)
    return quarters_back(F.date_format(last, "yyyyMMdd"), n)


def prior_year_end(report_date: Column) -> Column:
    return F.concat((F.substring(report_date, 1, 4).try_cast("int") - 1).cast("string"), F.lit("1231"))


def prior_year_same(report_date: Column) -> Column:
    return F.concat((F.substring(report_date, 1, 4).try_cast("int") - 1).cast("string"), month_day(report_date))


def strip_dashes(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def latest_session(calendar: DataFrame, now: Column, close: str = "15:30") -> DataFrame:
    """One row: the last session (calendar: trade_date) that has closed at the timestamp ``now``."""
    today = F.to_date(now)
    upto = F.when(F.date_format(now, "HH:mm") >= close, today).otherwise(F.date_sub(today, 1))
    return calendar.filter(F.col("trade_date") <= upto).agg(F.max("trade_date").alias("session"))


def is_session(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (date, ...) with ``is_session``."""
    known = calendar.select(F.col("trade_date").alias("date"), F.lit(True).alias("is_session")).distinct()
    return days.join(known, "date", "left").withColumn("is_session", F.coalesce("is_session", F.lit(False)))
