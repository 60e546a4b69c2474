"""Streams of events: windows with late data, labels of traces, new messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events and their value a window and type; rows later than the watermark are dropped on a stream."""
    timed = with_event_time(events, ts).withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of each key that end after a gap."""
    timed = with_event_time(events, ts).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")


def distinct_events(events: DataFrame, late: str = "10 minutes", key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return with_event_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
