"""Recordings as they arrive: files of a landing folder into the store, and windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def time_windows(events: DataFrame, size: str = "1 hour", step: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counts and mean values by window of ts and event_type; of a stream with a watermark, of a table without."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    window: Column = F.window("ts", size, step) if step else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def ingest_stream(spark: SparkSession, landing: str, store: str, checkpoint: str, schema):
    """Appends recordings that arrive as Parquet in landing to the store, once each; ends when all that is there has been read."""
    rows = spark.readStream.schema(schema).parquet(landing)
    return rows.writeStream.option("checkpointLocation", checkpoint).partitionBy("fault_type").format("parquet").option("path", store).trigger(availableNow=True).start()
