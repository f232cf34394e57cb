"""Streams of events: windowed counts with a watermark, and rows seen once. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n) for batches and streams; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def seen_once(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """A stream's rows without repeats of key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
