"""Streaming ingest: micro-batches of log records are committed once each, in order.

No watermark: no record is ever too late, the replay rules alone decide.  A batch that is tried again after
a failure is recognized by its number, which is part of the commit to the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.client import Namespace
from tidemark.sources import log


def read_records(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files of log records as a stream."""
    reader = spark.readStream.schema(log.schema(log.RECORD)).format("parquet")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def ingest(records: DataFrame, namespace: Namespace, checkpoint: str, interval: str | None = "200 milliseconds", compact_every: int | None = None) -> StreamingQuery:
    """Write a stream of log records to a namespace; with ``interval`` None, what there is now and stop.

    Records keep the order of their ``offset`` within a batch; batches follow one another.
    """
    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            namespace.write_frame(batch, batch=(checkpoint, number))
        if compact_every and number % compact_every == compact_every - 1:
            namespace.compact()

    writer = records.writeStream.foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def event_counts(events: DataFrame, column: str = "op") -> DataFrame:
    """Running counts of a stream by kind, for a monitor."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
