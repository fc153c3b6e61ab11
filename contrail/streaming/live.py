"""Structured Streaming forms: windows with a watermark, and sessions that close by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(points: DataFrame, every: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Points and mean speed in tumbling windows; the same for a batch and a stream. Needs event_time."""
    return points.withWatermark("event_time", late).groupBy("icao", F.window("event_time", every).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("gs_kt"), 3).alias("gs")).select("icao", F.col("w.start").alias("start"), "n", "gs")


def live_sessions(points: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions that end after ``gap`` without a point; state is kept by aircraft and dropped behind the watermark."""
    rows = points.withWatermark("event_time", late).groupBy("icao", F.session_window("event_time", gap).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.max("baro_ft").alias("max_alt_ft")).select("icao", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "max_alt_ft")
