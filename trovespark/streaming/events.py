"""Event logs as streams: counts per window, and per-trace state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovespark.sources.readers import EVENT


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window_start, event, n, traces) with a watermark; works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", window).alias("w"), "event").agg(F.count("*").alias("n"), F.approx_count_distinct("trace_id").alias("traces"))
    return counted.select(F.col("w.start").alias("window_start"), "event", "n", "traces")


def first_events(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Events without repeats of the same trace and event within the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.dropDuplicatesWithinWatermark(["trace_id", "event"]) if events.isStreaming else rows.dropDuplicates(["trace_id", "event"])
