"""Incremental loads as micro-batches: the batch upsert driven by a stream of files, writing only partitions it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dedupe import keep_last
from tidemark.operators.storage import cut, forget
from tidemark.plans.ingest import write_dataset


def upsert_stream(arriving: DataFrame, path: str, keys: list[str], partition: str, checkpoint: str) -> StreamingQuery:
    """Upsert all that has arrived into the dataset at ``path``, partitioned by the column ``partition`` (one of the keys or a
    function of them), batch by batch, and stop. A batch reads and rewrites the partitions that its rows have and no
    others; one that is repeated after a failure gives the same table, as the last row wins."""

    def batch(new: DataFrame, number: int) -> None:
        if new.isEmpty():
            return
        touched = new.select(partition).distinct()
        stored = new.sparkSession.read.schema(new.schema)
        try:
            old = stored.parquet(path).join(touched, partition, "left_semi")
            merged = cut(keep_last(old, new, keys), keep=False)
        except Exception as error:  # no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            merged = cut(keep_last(new.limit(0), new, keys), keep=False)
        write_dataset(merged.select(*new.columns), path, partition)
        forget(merged)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
