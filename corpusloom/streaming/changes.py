"""Structured Streaming: the incremental operators over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import apply_changes, changes


def file_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of each key in event-time windows; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))


def maintain_index(stream: DataFrame, spark: SparkSession, index_path: str, checkpoint: str):
    """Applies each micro-batch of (path, content_hash) as upserts to an index of numbered Parquet versions.

    A batch writes version ``batch_id`` from the version before it, so that a
    repeated batch gives the same result.  Paths that a batch does not mention stay.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by("content_hash", "seen").alias("content_hash"))
        if batch_id:
            index = spark.read.parquet(f"{index_path}/version={batch_id - 1}")
            touched = index.join(latest.select("path"), "path", "left_semi")
            found = changes(touched, latest)
            out = apply_changes(index, found, latest)
        else:
            out = latest
        out.write.mode("overwrite").parquet(f"{index_path}/version={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
