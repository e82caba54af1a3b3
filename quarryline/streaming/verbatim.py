"""Structured Streaming: verbatim ingestion with deduplication, windows over events, queue health, flush batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.exprs import chunk_estimate, verbatim_id


def dedup(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Entries (text, at) by content id, each once within the watermark."""
    return stream.withColumn("id", verbatim_id(F.col("text"))).withWatermark("at", within).dropDuplicatesWithinWatermark(["id"])


def windowed(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that replaces its own batch's folder, so a retried batch is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def flush_batches(queue: DataFrame, most: int = 5, chunks: int = 32) -> DataFrame:
    """queue(workspace, at, id, text) to (workspace, id, batch): at most `most` entries and `chunks` estimated chunks a batch.

    Each workspace's entries fill a batch in the order of arrival until the next one would pass either limit; an entry of
    more than `chunks` is a batch of its own.
    """

    def fill(batches):
        of, batch, held, size = object(), 0, 0, 0
        for rows in batches:
            out = []
            for workspace, c in zip(rows["workspace"].to_pylist(), rows["c"].to_pylist(), strict=True):
                if workspace != of:
                    of, batch, held, size = workspace, 0, 0, 0
                elif held == most or size + c > chunks:
                    batch, held, size = batch + 1, 0, 0
                held, size = held + 1, size + c
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows["workspace"], rows["id"], pa.array(out, pa.int64())], names=["workspace", "id", "batch"])

    q = queue.select("workspace", "at", "id", chunk_estimate(F.col("text")).alias("c"))
    schema = StructType([q.schema["workspace"], q.schema["id"], StructField("batch", LongType())])
    return q.repartition("workspace").sortWithinPartitions("workspace", "at", "id").select("workspace", "id", "c").mapInArrow(fill, schema)


def health(queue: DataFrame) -> DataFrame:
    """Pending entries, failures and the oldest arrival of each workspace (workspace, at, failed)."""
    return queue.groupBy("workspace").agg(F.count("*").alias("pending"), F.count(F.when(F.col("failed"), 1)).alias("failures"), F.min("at").alias("oldest"))
