"""When a growing file is ready, from a log of polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STABLE_SEC, TIMEOUT_SEC = 2.0, 900.0


def from_polls(polls: DataFrame, stable_for: float = STABLE_SEC, timeout: float = TIMEOUT_SEC) -> DataFrame:
    """polls (path, t in seconds, size_bytes, mtime_ns; null size: missing) to path, status (ready, timeout
    or waiting), at, size_bytes. Nothing and empty start anew, as does a changed signature; readiness is
    looked at before the timeout."""
    by = Window.partitionBy("path").orderBy("t")
    solid = F.coalesce(F.col("size_bytes") > 0, F.lit(False))
    same = solid & F.lag(solid).over(by) & (F.col("size_bytes") == F.lag("size_bytes").over(by)) & F.col("mtime_ns").eqNullSafe(F.lag("mtime_ns").over(by))
    d = polls.withColumns({"solid": solid, "fresh": F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)})
    d = d.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({"since": F.min("t").over(Window.partitionBy("path", "run")), "began": F.min("t").over(Window.partitionBy("path"))})
    ready = F.col("solid") & (F.col("t") - F.col("since") >= stable_for)
    late = F.col("t") - F.col("began") >= timeout
    d = d.groupBy("path").agg(
        F.min(F.when(ready, F.struct("t", "size_bytes"))).alias("ready"), F.min(F.when(late, F.col("t"))).alias("late"))
    is_ready = F.col("ready").isNotNull() & (F.col("late").isNull() | (F.col("ready.t") <= F.col("late")))
    return d.select(
        "path", F.when(is_ready, "ready").when(F.col("late").isNotNull(), "timeout").otherwise("waiting").alias("status"),
        F.when(is_ready, F.col("ready.t")).otherwise(F.col("late")).alias("at"), F.when(is_ready, F.col("ready.size_bytes")).alias("size_bytes"))
