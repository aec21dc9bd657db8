"""Reading the lake: declared schemas, widened schemas, dictionaries, calendars."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

#: Declared columns of the lake's datasets; what a file lacks reads as null, what is not declared is not read.
SCHEMAS = {
    "daily_kline": "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, amount DOUBLE, adj_factor DOUBLE, symbol STRING",
    "etf_kline": "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, amount DOUBLE, adj_factor DOUBLE, symbol STRING",
    "share_capital": "change_date DATE, total_shares BIGINT, symbol STRING",
    "fin_balance_sheet": "report_date STRING, publish_date STRING, available_date STRING, net_assets DOUBLE, symbol STRING",
    "fin_income_statement": "report_date STRING, publish_date STRING, available_date STRING, net_profit DOUBLE, revenue DOUBLE, symbol STRING",
    "fin_cashflow_statement": "report_date STRING, publish_date STRING, available_date STRING, ocf DOUBLE, symbol STRING",
    "fin_indicator": "report_date STRING, publish_date STRING, available_date STRING, deduct_net_profit DOUBLE, roe_weighted DOUBLE, operating_cashflow_to_revenue DOUBLE, symbol STRING",
    "fin_ttm": "report_date STRING, pub_date STRING, net_profit_ttm DOUBLE, deduct_net_profit_ttm DOUBLE, revenue_ttm DOUBLE, ocf_ttm DOUBLE, symbol STRING",
}
#: The lake's names of the columns above.
LAKE_NAMES = {"公告日期": "publish_date", "数据可用日期": "available_date", "归属于母公司所有者的净利润": "net_profit", "营业总收入": "revenue", "经营活动产生的现金流量净额": "ocf", "扣非净利润": "deduct_net_profit", "归属于母公司股东权益合计": "net_assets", "净资产收益率_加权": "roe_weighted", "经营现金流/营业收入": "operating_cashflow_to_revenue"}
STATEMENTS = {"balance": "fin_balance_sheet", "income": "fin_income_statement", "cashflow": "fin_cashflow_statement", "indicator": "fin_indicator"}
#: From the narrowest to the widest; any other type is wider still.
WIDTHS = ("string", "int", "bigint", "float", "double")


def dataset(spark: SparkSession, path: str, name: str, symbols: list[str] | None = None, lake_names: bool = False) -> DataFrame:
    """A dataset with its declared schema; a partition directory ``symbol=...`` fills the symbol as text, so a filter on it
    prunes directories. ``lake_names``: the files have the lake's column names."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    back = {v: k for k, v in LAKE_NAMES.items()} if lake_names else {}
    stored = T.StructType([T.StructField(back.get(f.name, f.name), f.dataType) for f in schema])
    df = spark.read.schema(stored).option("recursiveFileLookup", "false").parquet(path)
    df = df.select(*(F.col(f"`{back.get(f.name, f.name)}`").cast(f.dataType).alias(f.name) for f in schema))
    return df.filter(F.col("symbol").isin(*symbols)) if symbols is not None else df


def symbol_of_path(path: Column) -> Column:
    """The digits after ``symbol=`` in a file path."""
    return F.nullif(F.regexp_extract(path, r"symbol=(\d+)", 1), F.lit(""))


def with_path_symbol(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files read one by one, with the symbol from their paths."""
    return spark.read.schema(schema).parquet(*paths).withColumn("symbol", symbol_of_path(F.col("_metadata.file_path")))


def filings(spark: SparkSession, paths: dict[str, str], lake_names: bool = False) -> DataFrame:
    """The four filing sources as one table, tagged by ``source``; columns that a source lacks are null."""
    out = None
    for source, name in STATEMENTS.items():
        if source in paths:
            one = dataset(spark, paths[source], name, lake_names=lake_names).withColumn("source", F.lit(source))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no filing source")
    return out


def _width(kind: T.DataType) -> int:
    name = kind.simpleString()
    return WIDTHS.index(name) if name in WIDTHS else len(WIDTHS)


def widest_schema(variants: list[T.StructType]) -> T.StructType:
    """All columns of all variants by first appearance; of several types of a column the widest."""
    out: dict[str, T.DataType] = {}
    for schema in variants:
        for f in schema:
            if f.name not in out or _width(f.dataType) > _width(out[f.name]):
                out[f.name] = f.dataType
    return T.StructType([T.StructField(k, v) for k, v in out.items()])


def union_widened(variants: list[DataFrame]) -> DataFrame:
    """All rows of tables that disagree on columns and types, under the widest schema; text that is no number becomes
    null where a number is wider, and missing columns are null."""
    schema = widest_schema([v.schema for v in variants])
    cast = lambda v: v.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in v.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    out = cast(variants[0])
    for v in variants[1:]:
        out = out.unionByName(cast(v))
    return out


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, schema, columns) of each Parquet file below a folder: its schema as JSON, and that as an array of
    (name, type). Files are listed by Spark, and footers are read in its tasks, a few kilobytes a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for name in batch.column(0).to_pylist():
                store, at = (fs.LocalFileSystem(), "/" + name[5:].lstrip("/")) if name.startswith("file:") else fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as f:
                    footer = pq.read_metadata(f)
                own = from_arrow_schema(footer.schema.to_arrow_schema())
                for column, value in zip(out, (name, footer.num_rows, own.json(), [{"name": x.name, "type": x.dataType.simpleString()} for x in own]), strict=True):
                    column.append(value)
            columns = pa.array(out[3], pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), columns], ["path", "rows", "schema", "columns"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(read, "path string, rows long, schema string, columns array<struct<name: string, type: string>>")


def union_folder(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a folder of files that disagree on columns and types, under the widest schema (``union_widened``): one
    scan for each schema that occurs, so the plan grows with the schemas, not the files. A column that only folders'
    names hold (``symbol=...``) is read from them. An empty folder raises."""
    groups = footers(spark, path).groupBy("schema").agg(F.collect_list("path").alias("paths")).orderBy(F.desc(F.length("schema")), "schema").collect()
    if not groups:
        raise ValueError(f"no Parquet file below {path}")
    scan = lambda g: spark.read.schema(T.StructType.fromJson(json.loads(g["schema"]))).option("basePath", path).parquet(*sorted(g["paths"]))
    return union_widened([scan(g) for g in groups])


def schema_summary(spark: SparkSession, path: str) -> DataFrame:
    """(column_name, type, variants, rows) of a folder's files: in how many schemas a column has a type, and how many rows
    the files have that hold it so."""
    return footers(spark, path).select("schema", "rows", F.explode("columns").alias("c")).groupBy(F.col("c.name").alias("column_name"), F.col("c.type").alias("type")).agg(F.countDistinct("schema").alias("variants"), F.sum("rows").alias("rows"))


def indicator_names(spark: SparkSession, path: str, limit: int = 1000) -> dict[str, str]:
    """indicator_key -> name of the dictionary file, a few hundred rows."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8").select("indicator_key", "name_cn").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{path} has more than {limit} rows")
    return {r[0]: r[1] for r in rows if r[0] and r[1]}


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(trade_date) of a stored calendar; raises if it is empty or holds what is no date."""
    rows = spark.read.parquet(path)
    rows = rows.select(F.col("trade_date").cast("string").alias("t")).select("t", F.to_date(F.try_to_timestamp("t")).alias("trade_date"))
    n, bad = rows.agg(F.count("*"), F.count_if(F.col("trade_date").isNull())).first()
    if not n or bad:
        raise ValueError(f"the calendar at {path} has {n} rows, {bad} of them without a date")
    return rows.select("trade_date").distinct()


def active(stocks: DataFrame) -> DataFrame:
    """(symbol, name) of the rows that are active."""
    return stocks.filter("is_active = 1").select("symbol", "name")


def benchmark_prices(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """(date, close_hfq) of one symbol between two dates; the filter reaches the scan."""
    rows = bars.filter((F.col("symbol") == symbol) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.select("date", (F.col("close") * F.col("adj_factor")).alias("close_hfq")).orderBy("date")
