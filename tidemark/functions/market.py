"""Column functions on security codes, addresses and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The provinces that a registered address may name.
PROVINCES = ("北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "内蒙古", "广西", "西藏", "宁夏", "新疆", "台湾", "香港", "澳门")


def _starts(code: Column, *heads: str) -> Column:
    return code.rlike(f"^({'|'.join(heads)})")


def exchange(code: Column) -> Column:
    """SZ for codes from 0 to 3, BJ for 4, 8 and 920, else SH (5, 6, other 9, anything else)."""
    return F.when(_starts(code, "[0-3]"), "SZ").when(_starts(code, "4", "8", "920"), "BJ").otherwise("SH")


def prefixed(code: Column) -> Column:
    """``sh600519``."""
    return F.concat(F.lower(exchange(code)), code)


def market_symbol(text: Column) -> Column:
    """``300274.SZ`` of ``sz300274``; a text without such a prefix in upper case."""
    return F.when(text.rlike("^(SH|SZ|BJ|sh|sz|bj)"), F.concat(F.substring(text, 3, 100), F.lit("."), F.upper(F.substring(text, 1, 2)))).otherwise(F.upper(text))


def etf_symbol(code: Column) -> Column:
    """``SH510300``: SZ for 15, 16, 18, else SH."""
    return F.concat(F.when(_starts(code, "15", "16", "18"), "SZ").otherwise("SH"), code)


def current_bse_code(code: Column) -> Column:
    """Codes of old that start with 4 or 8 are 920 and their last three digits now."""
    return F.when(_starts(code, "4", "8"), F.concat(F.lit("920"), F.right(code, F.lit(3)))).otherwise(code)


def pad_code(code: Column) -> Column:
    """Six digits with leading zeros; a longer text is kept whole."""
    text = code.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def province(address: Column) -> Column:
    """The province that an address starts with, else one inside its first short brackets, else null."""
    names = "|".join(PROVINCES)
    inside = F.regexp_extract(address, r"[(（](.{1,4}?)[)）]", 1)  # up to four characters in brackets
    return F.coalesce(F.nullif(F.regexp_extract(address, f"^({names})", 1), F.lit("")), F.nullif(F.regexp_extract(inside, f"({names})", 1), F.lit("")))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f%%", x * 100)).otherwise("—")


def number(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise("—")
