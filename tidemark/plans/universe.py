"""The universe of symbols: differences, delistings, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.market import blank_to_null, pad_code
from tidemark.operators.dedupe import first_by


def diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(symbol, name, is_active, action) of the universe after an update: insert what is new, update a changed name, restore
    what was inactive and is back, delist what is gone, none otherwise. stored: symbol, name, is_active; incoming: symbol,
    name. An empty incoming list raises, as it would delist everything."""
    if incoming.isEmpty():
        raise ValueError("the incoming list is empty; nothing is changed")
    s = stored.select("symbol", F.col("name").alias("old"), F.col("is_active").alias("was"), F.lit(True).alias("here"))
    i = first_by(incoming.select("symbol", F.col("name").alias("new"), F.lit(True).alias("there")), ["symbol"], F.desc("new"))
    action = F.when(F.col("here").isNull(), "insert").when(F.col("there").isNull(), F.when(F.col("was") == 1, "delist").otherwise("none"))
    action = action.when(F.col("was") == 0, "restore").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("none")
    return s.join(i, "symbol", "full_outer").select("symbol", F.when(F.col("there"), F.col("new")).otherwise(F.col("old")).alias("name"), F.when(F.col("there"), 1).otherwise(0).alias("is_active"), action.alias("action"))


def counts(universe: DataFrame) -> DataFrame:
    return universe.agg(F.count("*").alias("total"), F.count_if(F.col("is_active") == 0).alias("inactive"))


def merge_delisted(stored: DataFrame, *lists: DataFrame) -> DataFrame:
    """stored and, as inactive, the codes of delisted lists (code, name) that it lacks; of a code in several lists the row of
    the first. Stored rows never change."""
    found = None
    for k, one in enumerate(lists):
        own = one.select(pad_code(F.col("code")).alias("symbol"), "name", F.lit(k).alias("k"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return stored
    new = first_by(found, ["symbol"], F.asc("k")).join(stored.select("symbol"), "symbol", "left_anti").select("symbol", "name", F.lit(0).alias("is_active"))
    return stored.unionByName(new, allowMissingColumns=True)


def last_trade_dates(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """universe with last_trade_date: the last bar's date of inactive symbols, null for active ones."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("d"))
    return universe.drop("last_trade_date").join(last, "symbol", "left").withColumn("last_trade_date", F.when(F.col("is_active") == 0, F.col("d"))).drop("d")


def listing_dates(bars: DataFrame) -> DataFrame:
    """(symbol, list_date): the first bar's date as YYYYMMDD."""
    return bars.groupBy("symbol").agg(F.date_format(F.min("date"), "yyyyMMdd").alias("list_date"))


def fill_metadata(universe: DataFrame, fields: list[str], *sources: DataFrame) -> DataFrame:
    """universe with blank fields filled from the sources (symbol, fields) in order; what it has stays."""
    out, have = universe, {f: [blank_to_null(F.col(f))] for f in fields}
    for k, one in enumerate(sources):
        own = [f for f in fields if f in one.columns]
        flat = first_by(one.select("symbol", *own), ["symbol"]).select("symbol", *(F.col(f).alias(f"_{k}_{f}") for f in own))
        out = out.join(flat, "symbol", "left")
        for f in own:
            have[f].append(blank_to_null(F.col(f"_{k}_{f}")))
    return out.withColumns({f: F.coalesce(*cols) for f, cols in have.items()}).select(*universe.columns)
