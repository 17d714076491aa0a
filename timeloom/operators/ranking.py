"""Ranking of candidate clips: blend, threshold, suppress overlaps, cut to the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.errors import TimelineError, UnknownName
from timeloom.functions.scores import final_score, heuristic_score

from .intervals import suppress_contained

#: Of equal score and start the order in which the clips came decides.
BEST_FIRST = ("-final_score", "start_us", "pos")


def _ordered(names) -> list[Column]:
    return [-F.col(n[1:]) if n[0] == "-" else F.col(n) for n in names]


def with_scores(clips: DataFrame) -> DataFrame:
    """Adds heuristic_score and final_score to clips with a model score."""
    seconds = (F.col("end_us") - F.col("start_us")) / 1_000_000
    d = clips.withColumn("heuristic_score", heuristic_score(seconds))
    return d.withColumn("final_score", final_score(F.col("score"), F.col("heuristic_score")))


def numbered(df: DataFrame, order=BEST_FIRST, key: str = "video_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*_ordered(order))))


def rank(clips: DataFrame, min_score: int | Column = 5, max_clips: int = 20, overlap: float = 0.5) -> DataFrame:
    """Clips that reach min_score, without those that mostly repeat a better one, the best max_clips
    of each video; `rank` counts from 1."""
    d = with_scores(clips).where(F.col("final_score") >= min_score)
    d = suppress_contained(d, "video_id", "start_us", "end_us", _ordered(BEST_FIRST), overlap)
    return numbered(d).where(F.col("rank") <= max_clips)


def threshold_for(profile_score: Column, configured: int) -> Column:
    return F.coalesce(profile_score, F.lit(configured))


def reel_order(clips: DataFrame, order: str) -> DataFrame:
    """Numbers clips (`at`) for a merged reel: chronological; alternating (best first); score (as they come)."""
    orders = {"chronological": ("start_us", "pos"), "alternating": BEST_FIRST, "score": ("pos",)}
    if order not in orders:
        raise UnknownName(f"order {order!r}: one of {sorted(orders)}")
    return numbered(clips, orders[order], name="at")


def rolled(clips: DataFrame, before: float, after: float, duration_us: Column) -> DataFrame:
    """Widens clips by seconds, inside the timeline; untouched, not even clamped, if both are 0."""
    if before < 0 or after < 0:
        raise TimelineError("roll must not be negative")
    if before == after == 0:
        return clips
    start = F.greatest(F.lit(0).cast("long"), F.col("start_us") - round(before * 1_000_000))
    end = F.least(duration_us, F.col("end_us") + round(after * 1_000_000))
    return clips.withColumns({"start_us": start, "end_us": end})
