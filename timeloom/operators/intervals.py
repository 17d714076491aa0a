"""Overlap of intervals: pairs, greedy suppression, tolerance de-dup, slices.

Greedy suppression looks at the rows kept so far, so it is a fold, not a window. A timeline is first
cut into islands of touching intervals, which cannot suppress each other; small islands are folded as they come,
crowded ones are settled in parallel rounds.
"""

from __future__ import annotations

import functools
import logging
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.errors import TimelineError
from timeloom.functions.scores import overlap_fraction, temporal_iou
from timeloom.tables import cut, scratch

from .chains import chain

log = logging.getLogger(__name__)

#: Rows of an island that is folded as it comes; rounds for larger ones, and the share of rows that one must settle.
SHORT, ROUNDS, LEAST_SHARE = 256, 12, 0.1
#: Powers of four seconds: the narrowest and the widest bucket of a slice.
_FINEST, _COARSEST = -10, 40
_PLACE = ["_key", "_island", "_p"]
#: What becomes of an island: folded at once, settled in rounds, or folded by Spark, as some of its times are null or NaN.
_FOLDED, _CROWDED, _UNKNOWN = 0, 1, 2


def islands(df: DataFrame, key: str, start: str, end: str, name: str = "island") -> DataFrame:
    """Numbers the groups of intervals that overlap directly or through others."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) < reach, 0).otherwise(1)
    return df.withColumn(name, F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def _suppress(df: DataFrame, key: str, start: str, end: str, order: list[Column], clash, plain, short: int = SHORT) -> DataFrame:
    """Keeps a row unless it clashes with one kept before it in `order`. clash: of columns; plain: the same of floats."""
    columns, inside = [F.col(f"`{c}`") for c in df.columns], Window.partitionBy(key, "_island")
    place = F.row_number().over(inside.orderBy(*order, start, end, *columns))
    unknown = functools.reduce(Column.__or__, (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in (start, end)))
    way = F.when(F.count("*").over(inside) > short, _CROWDED).when(F.count_if(unknown).over(inside) > 0, _UNKNOWN).otherwise(_FOLDED)
    # Rows are dealt once, by key, and each task goes through its islands as they come; those not folded pass.
    d = islands(df, key, start, end, "_island").withColumn("_p", place).withColumn("_way", way).sortWithinPartitions(key, "_island")  # already so: costs no sort
    names = ["_p", "_way", start, end]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _folded(batches, names, plain)

    d = d.mapInArrow(run, d.schema)
    d = d.select(F.struct(F.col(key)).alias("_key"), "_island", "_p", "_way", F.col(start).alias("_a"), F.col(end).alias("_b"), F.struct(*columns).alias("_row"))
    with scratch(df.sparkSession) as result:
        d = cut(d, "islands")
        ways = {r["_way"] for r in d.select("_way").distinct().collect()}  # three at most
        crowded = d.where(F.col("_way") == _CROWDED)
        kept = cut(_settled(crowded.drop("_way", "_row"), clash, plain), "settled") if _CROWDED in ways else None
        result += [d] if kept is None else [d, kept]
    out = d.where(F.col("_way") == _FOLDED).select("_row.*")
    if _UNKNOWN in ways:
        out = out.unionByName(_compared(d.where(F.col("_way") == _UNKNOWN), clash))
    return out if kept is None else out.unionByName(crowded.join(kept, _PLACE).select("_row.*"))


def _folded(batches: Iterable[pa.RecordBatch], names: list[str], plain) -> Iterator[pa.RecordBatch]:
    """Of rows that come island by island and best first, those that clash with none kept before. Held are the times
    of what one island keeps, as many as are folded at most."""
    kept: list[tuple] = []
    before = 0
    for batch in batches:
        keep = []
        for i, (p, way, lo, hi) in enumerate(zip(*(_values(batch.column(n)) for n in names), strict=True)):
            if p == 1:
                kept = []
            elif p != before + 1:
                raise RuntimeError("rows of an island came out of order")
            before = p
            if way == _FOLDED:
                for c, d in kept:
                    if c < hi and lo < d and plain(lo, hi, c, d):  # neither measure is over 0 without shared time
                        break
                else:
                    kept.append((lo, hi))
                    keep.append(i)
            else:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _compared(d: DataFrame, clash) -> DataFrame:
    """As _folded, of small islands with nulls or NaN among their times, which count as Spark compares them."""
    groups = d.groupBy("_key", "_island").agg(F.sort_array(F.collect_list(F.struct("_p", "_a", "_b", "_row"))).alias("items"))
    fold = F.aggregate("items", F.slice("items", 1, 0), lambda acc, x: F.when(
        F.exists(acc, lambda y: clash(x["_a"], x["_b"], y["_a"], y["_b"])), acc).otherwise(F.concat(acc, F.array(x))))
    return groups.select(F.explode(fold).alias("k")).select("k._row.*")


def _settled(d: DataFrame, clash, plain) -> DataFrame:
    """_key, _island, _p of the rows that stay, of crowded islands (_key, _island, _p, _a, _b).

    Rows are filed under time buckets as wide as an island's mean interval, some two each. In a round, a row that
    is first in each of its buckets stays, as nothing that overlaps it comes before it; rows that clash with it go. At
    most one row a bucket stays in a round, so a round moves the filed rows and no pairs. When rounds settle
    little, what is left falls apart into smaller islands, and each is gone through in order by one task."""
    wide = cut(d.groupBy("_key", "_island").agg(F.greatest(F.avg(F.col("_b") - F.col("_a")), F.lit(1e-9)).alias("_w")), "widths")
    buckets = F.sequence(F.floor(F.col("_a") / F.col("_w")), F.floor(F.col("_b") / F.col("_w")))
    left = cut(d.join(wide, ["_key", "_island"]).withColumn("_bucket", F.explode(buckets)).drop("_w"), "filed")
    cell, stay, waiting = ["_key", "_island", "_bucket"], [], d.count()
    for n in range(1, ROUNDS + 1):
        best = left.groupBy(cell).agg(F.min(F.struct("_p", "_a", "_b")).alias("_best"))
        judged = cut(left.join(best, cell), "judged")
        first = judged.groupBy(_PLACE).agg(F.bool_and(F.col("_p") == F.col("_best._p")).alias("_first")).where("_first").select(_PLACE)
        stay.append(first := cut(first, "first"))
        beaten = judged.join(first.select("_key", "_island", F.col("_p").alias("_q")), (judged["_key"] == first["_key"]) & (judged["_island"] == first["_island"]) & (judged["_best"]["_p"] == F.col("_q")), "left_semi")
        beaten = beaten.where(clash(F.col("_a"), F.col("_b"), F.col("_best._a"), F.col("_best._b")) | (F.col("_p") == F.col("_best._p"))).select(_PLACE).distinct()
        left = cut(left.join(beaten, _PLACE, "left_anti"), "filed")
        before, waiting = waiting, left.select(_PLACE).distinct().count()
        log.info("suppression round %d: %d rows settled, %d left", n, before - waiting, waiting)
        if not waiting or before - waiting < before * LEAST_SHARE:
            break
    if waiting:
        stay.append(_in_turn(d.join(left.select(_PLACE).distinct(), _PLACE), plain))
    return functools.reduce(DataFrame.unionByName, stay)


def _in_turn(d: DataFrame, plain) -> DataFrame:
    """Greedy suppression of each island of what is left, by one task."""
    by = Window.partitionBy("_key", "_island").orderBy("_a", "_b")
    reach = F.max("_b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("_a") < reach, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        a, b = table["_a"].to_pylist(), table["_b"].to_pylist()
        width = max((sum(b) - sum(a)) / len(a), 1e-9)
        kept: dict[int, list[int]] = {}
        stay = []
        for i, (lo, hi) in enumerate(zip(a, b, strict=True)):
            cells = range(math.floor(lo / width), math.floor(hi / width) + 1)
            if not any(plain(lo, hi, a[j], b[j]) for c in cells for j in kept.get(c, ())):
                stay.append(i)
                for c in cells:
                    kept.setdefault(c, []).append(i)
        return table.select(_PLACE).take(stay)

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in _PLACE)
    return d.withColumn("_part", part).groupBy("_key", "_island", "_part").applyInArrow(run, kinds)


def _iou(a: float, b: float, c: float, d: float) -> float:
    hull = max(b, d) - min(a, c)
    return max(0, min(b, d) - max(a, c)) / hull if hull > 0 else 0.0


def _fraction(a: float, b: float, c: float, d: float) -> float:
    shorter = min(b - a, d - c)
    return max(0, min(b, d) - max(a, c)) / shorter if shorter > 0 else 0.0


def suppress_iou(df: DataFrame, key: str, start: str, end: str, order: list[Column], threshold: float = 0.5, short: int = SHORT) -> DataFrame:
    """Drops rows whose temporal IoU with a kept one is threshold or more."""
    if threshold <= 0:
        raise TimelineError("threshold must be over 0")
    return _suppress(df, key, start, end, order, lambda a, b, c, d: temporal_iou(a, b, c, d) >= threshold, lambda a, b, c, d: _iou(a, b, c, d) >= threshold, short)


def suppress_contained(df: DataFrame, key: str, start: str, end: str, order: list[Column], threshold: float = 0.5, short: int = SHORT) -> DataFrame:
    """Drops rows that share more than threshold of the shorter one with a kept row."""
    if threshold < 0:
        raise TimelineError("threshold must not be negative")
    return _suppress(df, key, start, end, order, lambda a, b, c, d: overlap_fraction(a, b, c, d) > threshold, lambda a, b, c, d: _fraction(a, b, c, d) > threshold, short)


def overlap_pairs(df: DataFrame, key: str, row_id: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of overlapping intervals of a timeline with both measures.

    Each interval is filed under the time buckets that it touches, which bounds what meets; a pair is
    reported by the bucket in which the later one of its starts lies."""
    def side(p):
        d = df.select(F.col(key), F.col(row_id).alias(f"{p}_id"), F.col(start).alias(f"{p}_start"), F.col(end).alias(f"{p}_end"))
        first, last = F.floor(F.col(f"{p}_start") / bucket), F.floor((F.col(f"{p}_end") - 1) / bucket)
        return d.where(F.col(f"{p}_end") > F.col(f"{p}_start")).withColumn("bucket", F.explode(F.sequence(first, last)))

    pairs = side("a").join(side("b"), [key, "bucket"])
    meet = F.greatest("a_start", "b_start")
    pairs = pairs.where((F.col("a_id") < F.col("b_id")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    pairs = pairs.where(F.floor(meet / bucket) == F.col("bucket"))
    args = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    return pairs.select(key, "a_id", "b_id", temporal_iou(*args).alias("iou"), overlap_fraction(*args).alias("fraction"))


def thin(df: DataFrame, key: str, time: str, order: list[Column], gap: float) -> DataFrame:
    """Drops rows closer than gap to the last row kept."""
    return chain(df, key, time, order, gap)


def concat_ordered(*frames: DataFrame) -> DataFrame:
    """UNION ALL of frames with the columns `part` (which frame) and all of theirs."""
    if not frames:
        raise TimelineError("nothing to concatenate")
    out = frames[0].withColumn("part", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("part", F.lit(i)))
    return out


def sliced(rows: DataFrame, cuts: DataFrame, t: str = "t") -> DataFrame:
    """rows (video_id, t, ...) that lie in a cut (video_id, cut_id, start_sec, end_sec), its end excluded: each
    row once a cut, with cut_id and the time since the cut's start (`since`).

    Cuts are filed under the time buckets that they touch. A cut's buckets are a power of four as wide as it is
    at least, so there are two of them at most; a row looks into one bucket of each width in use. What meets is
    thus in proportion to what is returned, and Spark can split a bucket with many rows."""
    c = cuts.select("video_id", "cut_id", "start_sec", "end_sec").where("end_sec > start_sec")
    length = F.col("end_sec") - F.col("start_sec")
    level = F.least(F.greatest(F.ceil(F.log2(length) / 2), F.lit(_FINEST)), F.lit(_COARSEST)).cast("int")
    width = lambda at: F.pow(F.lit(4.0), at)
    c = c.withColumn("_level", level)
    levels = [r["_level"] for r in c.select("_level").distinct().collect()]  # at most a row for each width
    last = F.least(F.col("end_sec"), F.col("start_sec") + width(F.col("_level")))
    c = c.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_sec") / width(F.col("_level"))), F.floor(last / width(F.col("_level"))))))
    d = rows.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    d = d.withColumn("_bucket", F.floor(F.col(t) / width(F.col("_level")))).join(c, ["video_id", "_level", "_bucket"])
    d = d.where((F.col(t) >= F.col("start_sec")) & (F.col(t) < F.col("end_sec")))
    return d.withColumn("since", F.col(t) - F.col("start_sec")).drop("start_sec", "end_sec", "_level", "_bucket")
