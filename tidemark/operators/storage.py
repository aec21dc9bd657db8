"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one is set in local mode, as in tests; on a
    cluster, whose machines do not see each other's temporary folders, that raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace(spark: SparkSession, made: str, path: str) -> None:
    """The folder ``made`` takes the place of ``path``."""
    at, to = spark._jvm.org.apache.hadoop.fs.Path(made), spark._jvm.org.apache.hadoop.fs.Path(path)
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(to, True)
    if not files.rename(at, to):
        raise OSError(f"{made} cannot be renamed to {path}")
    spark.catalog.refreshByPath(path)


def cut(df: DataFrame, keep: bool = True) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lost executor then costs a re-read, not the
    whole lineage, and later plans do not grow by this one. The table is deleted when the driver's Python ends, or by
    ``forget`` if it is superseded."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    if keep:
        atexit.register(drop, spark, path)
    return back


def forget(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing lazy depends on any more."""
    if path := getattr(df, "_cut_path", None):
        drop(df.sparkSession, path)
