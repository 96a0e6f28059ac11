"""Structured Streaming front end: events to hourly series, appended batch by batch.

A stream never emits empty bins; batch code fills them from the finished table
(sources.series.resample), so the stream only appends the bins that closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(ts, series_name, value): hourly sums that close once the watermark has passed them."""
    binned = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.sum("value").alias("value"))
    return binned.select(F.col("window.start").alias("ts"), F.col("event_type").alias("series_name"), "value")


def append_to(events: DataFrame, path: str, checkpoint: str, lateness: str = "2 hours"):
    """A query that appends closed bins to a Parquet table; the file sink writes each batch once."""
    writer = hourly(events, lateness).writeStream.outputMode("append").format("parquet")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
