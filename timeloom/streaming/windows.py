"""Tumbling and hopping windows over event time; the same code serves batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping(events: DataFrame, time: str, value: str, length: str, hop: str, keys=(), late: str | None = None) -> DataFrame:
    """Count, sum and greatest value of each window (and key). late: how long a stream waits for
    late rows; windows are emitted once it has passed."""
    d = events.withWatermark(time, late) if late else events
    w = F.window(time, length, hop)
    d = d.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))
    return d.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total", "top")


def tumbling(events: DataFrame, time: str, value: str, length: str, keys=(), late: str | None = None) -> DataFrame:
    return hopping(events, time, value, length, length, keys, late)
