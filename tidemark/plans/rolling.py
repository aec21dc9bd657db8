"""Daily valuation kept up to date: a new day costs its bars, the filings that became known since, and one remembered row
a symbol; no history is read.

Under ``root`` lie the valuations, the three right sides with the dates from which they are known, and the state: of each
symbol and side the last row known on the day up to which all is valued. What becomes known later for a day that is
valued already comes back from ``learn`` and is valued anew from that day on, for its symbols only.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.asof import Right, last_state, with_state
from tidemark.operators.dedupe import first_by
from tidemark.operators.storage import cut, drop, exists, forget
from tidemark.plans import valuation
from tidemark.sources.store import Layout, Store

TTM = "net_profit_ttm DOUBLE, deduct_net_profit_ttm DOUBLE, revenue_ttm DOUBLE, ocf_ttm DOUBLE"
#: Right sides: their values, and the column that decides among rows of a day.
SIDES = {"capital": "total_shares BIGINT", "ttm": TTM, "equity": "net_assets DOUBLE"}
VALUES = "date DATE, symbol STRING, raw_close DOUBLE, close_hfq DOUBLE, total_shares BIGINT, market_cap DOUBLE, pe_ttm DOUBLE, pe_deduct_ttm DOUBLE, pb DOUBLE, ps_ttm DOUBLE, pcf_ttm DOUBLE"
BEGIN = dt.date(1600, 1, 1)


@dataclass
class Rolling:
    spark: SparkSession
    root: str
    buckets: int = 16

    @property
    def values(self) -> Store:
        return Store(self.spark, f"{self.root}/valuation", Layout(VALUES, ("symbol", "date"), "date", self.buckets))

    def side(self, name: str) -> Store:
        """A right side by the year from which a row is known. A revision that becomes known on another day is a row of
        its own: days before it keep what was known on them."""
        return Store(self.spark, f"{self.root}/{name}", Layout(f"symbol STRING, report_date STRING, eff DATE, {SIDES[name]}", ("symbol", "report_date", "eff"), "eff", self.buckets))

    def as_of(self) -> dt.date:
        """The day up to which all is valued."""
        if not exists(self.spark, f"{self.root}/state"):
            return BEGIN
        return self.spark.read.schema(self._state_schema() + ", as_of DATE").parquet(f"{self.root}/state").agg(F.max("as_of")).first()[0]

    def _state_schema(self) -> str:
        return "symbol STRING, " + ", ".join(f"_r{k} STRUCT<`on`: DATE, {v.replace(' DOUBLE', ': DOUBLE').replace(' BIGINT', ': BIGINT')}>" for k, v in enumerate(SIDES.values()))

    def _state(self, day: dt.date) -> DataFrame:
        if day == BEGIN:
            return self.spark.createDataFrame([], self._state_schema())
        return self.spark.read.schema(self._state_schema()).parquet(f"{self.root}/state/as_of={day}")

    def _right(self, name: str, rows: DataFrame) -> Right:
        columns = [x.split()[0] for x in SIDES[name].split(", ")]
        return Right(first_by(rows, ["symbol", "eff"], F.desc("report_date")).select("symbol", "eff", *columns), "eff", columns)

    def learn(self, capital: DataFrame | None = None, ttm: DataFrame | None = None, filings: DataFrame | None = None) -> DataFrame:
        """Take in new rows of the sources, as ``valuation.daily_valuation`` has them; (symbol, since) comes back for those
        that were known on days which are valued already."""
        new = {
            "capital": capital and capital.select("symbol", F.col("change_date").cast("string").alias("report_date"), F.col("change_date").alias("eff"), "total_shares"),
            "ttm": ttm and ttm.withColumn("eff", D.as_date(F.col("pub_date"))),
            "equity": filings and filings.filter("source = 'balance'").withColumn("eff", D.effective_date(F.col("available_date"), F.col("publish_date"))),
        }
        day, late = self.as_of(), self.spark.createDataFrame([], "symbol STRING, since DATE")
        for name, rows in new.items():
            if rows is not None:
                rows = cut(rows.filter("eff IS NOT NULL").select(*self.side(name).layout.columns))
                self.side(name).upsert(rows)
                late = late.unionByName(rows.filter(F.col("eff") <= F.lit(day)).select("symbol", F.col("eff").alias("since")))
        return late.groupBy("symbol").agg(F.min("since").alias("since"))

    def fresh(self, after: dt.date, upto: dt.date) -> list[Right]:
        """The right sides' rows that became known after a day; folders of earlier years are not opened."""
        known = (F.col("eff") > F.lit(after)) & (F.col("eff") <= F.lit(upto)) & F.col("_year").between(after.year, upto.year)
        return [self._right(name, self.side(name).read(known)) for name in SIDES]

    def advance(self, bars: DataFrame, upto: dt.date) -> DataFrame:
        """Value the bars after ``as_of()`` up to a day, store the rows and the state, and give the rows back. Rows come
        first: a run that is repeated after a failure writes the same ones again."""
        after = self.as_of()
        if upto <= after:
            raise ValueError(f"all days up to {after} are valued already")
        own = bars.filter((F.col("date") > F.lit(after)) & (F.col("date") <= F.lit(upto)))
        sides = with_state(self._state(after), *self.fresh(after, upto))
        rows = cut(valuation.valued(own, *sides))
        self.values.upsert(rows)
        self._remember(cut(last_state(*sides, upto=F.lit(upto)), keep=False), upto)
        return rows

    def _remember(self, state: DataFrame, day: dt.date) -> None:
        before = self.as_of()
        state.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/state/as_of={day}")
        forget(state)
        if before not in (BEGIN, day):
            drop(self.spark, f"{self.root}/state/as_of={before}")

    def revalue(self, bars: DataFrame, late: DataFrame) -> int:
        """Value anew what ``learn`` gave back: the symbols' valued bars from that day on, with all that is known about
        them, and their part of the state. ``bars``: stored ones; gives the number of folders written."""
        late, day = cut(late), self.as_of()
        if late.isEmpty():
            return 0
        sides = [self._right(name, self.side(name).of(late)) for name in SIDES]
        own = bars.join(F.broadcast(late) if late.count() <= 100_000 else late, "symbol").filter((F.col("date") >= F.col("since")) & (F.col("date") <= F.lit(day)))
        done = self.values.upsert(valuation.valued(own, *sides))
        state = self._state(day).join(late, "symbol", "left_anti").unionByName(last_state(*sides, upto=F.lit(day)))
        self._remember(cut(state, keep=False), day)
        return done
