"""Scores of clips and measures of overlap, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A neutral base, a penalty outside the comfortable lengths (bounds included in them).
BASE, PENALTY, SHORTEST_SEC, LONGEST_SEC = 5.0, 3.0, 3.0, 60.0


def clamp(x: Column, low=0, high=10) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def duration_score(seconds: Column) -> Column:
    off = (seconds < SHORTEST_SEC) | (seconds > LONGEST_SEC)
    return clamp(F.lit(BASE) - F.when(off, PENALTY).otherwise(0.0), 0.0, 10.0)


def heuristic_score(seconds: Column) -> Column:
    """The duration score, rounded half to even."""
    return F.bround(duration_score(seconds), 0).cast("int")


def final_score(model: Column, heuristic: Column) -> Column:
    return clamp(model + heuristic - 5).cast("int")


def _shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared time over the hull of both; 0 where the hull is empty."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, _shared(a0, a1, b0, b1) / hull).otherwise(0.0)


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared time over the shorter of both; 0 where that is empty."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, _shared(a0, a1, b0, b1) / shorter).otherwise(0.0)
