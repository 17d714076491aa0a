"""Peaks of an energy envelope: frames, rolling median, robust threshold, islands, widths, gap merge.

A timeline's envelope stays rows throughout, dealt over tasks in blocks of frames: no row and no group holds a
timeline. Frames count by their place among those of their timeline; frames without a finite value don't.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.tables import cut, scratch

from .chains import chain

# Fixed values.
RATE, FRAME_MS, BASELINE_SEC, K_DEFAULT, MIN_GAP_SEC = 16_000, 100, 15.0, 4.0, 2.0
IQR_TO_SIGMA, FLOOR_SHARE, IMPACT_SEC = 1.349, 0.15, 0.8
#: Frames that a task takes medians of at once; ranges of values that ranks are counted in; minima in a node.
BLOCK, RANGES, FAN = 4096, 1024, 64


def rms_frames(samples: DataFrame, per_frame: int = RATE * FRAME_MS // 1000, rate: float = RATE) -> DataFrame:
    """samples (video_id, i, x) to video_id, frame, t (centre), e (root mean square); a frame that is
    not full is dropped."""
    frame = F.floor(F.col("i") / per_frame)
    d = samples.groupBy("video_id", frame.alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("e"), F.count("x").alias("n"))
    return d.where(F.col("n") == per_frame).select("video_id", "frame", ((F.col("frame") + 0.5) * per_frame / rate).alias("t"), "e")


def placed(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """video_id, frame, e, and i, the frame's place in its timeline (from 0), and n, the timeline's frames.
    Places are counted in cells of frame numbers, whose sizes are summed up before."""
    finite = F.abs("e") < float("inf")  # neither null nor NaN
    d = frames.select("video_id", F.col("frame").cast("long").alias("frame"), F.col("e").cast("double").alias("e"), F.floor(F.col("frame") / block).alias("_cell")).where(finite)
    by = Window.partitionBy("video_id")
    cells = d.groupBy("video_id", "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("video_id", "_cell", before.alias("_before"), F.sum("_n").over(by).alias("n"))
    at = F.row_number().over(Window.partitionBy("video_id", "_cell").orderBy("frame")) - 1
    return d.join(cells, ["video_id", "_cell"]).select("video_id", "frame", "e", (F.col("_before") + at).alias("i"), "n")


def rolling_median(frames: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """video_id, frame, e, i, n and `baseline`: the median around each frame, the ends repeated outwards; the
    window is no longer than the timeline. A block's task also gets the frames that its windows reach, and
    moves one sorted window along."""
    block = max(block, 4 * window)
    w = F.least(F.lit(window), F.col("n"))
    half = F.floor(w / 2)
    first = F.floor(F.greatest(F.col("i") - (w - half - 1), F.lit(0)) / block)
    last = F.floor(F.least(F.col("i") + half, F.col("n") - 1) / block)
    d = placed(frames).withColumn("_block", F.explode(F.sequence(first, last)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_block") + ", baseline double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        at, n = table["_block"][0].as_py(), table["n"][0].as_py()
        start, values, w = table["i"][0].as_py(), table["e"].to_pylist(), min(window, n)
        lo, hi = at * block, min((at + 1) * block, n)
        value = lambda i: values[min(max(i, 0), n - 1) - start]
        held = sorted(value(i) for i in range(lo - w // 2, lo - w // 2 + w))
        found = []
        for i in range(lo, hi):
            found.append((held[(w - 1) // 2] + held[w // 2]) / 2)
            if i + 1 < hi:
                del held[bisect.bisect_left(held, value(i - w // 2))]
                bisect.insort(held, value(i - w // 2 + w))
        return table.drop_columns("_block").slice(lo - start, hi - lo).append_column("baseline", pa.array(found, pa.float64()))

    return d.groupBy("video_id", "_block").applyInArrow(run, kinds)


def residuals(frames: DataFrame, window: int) -> DataFrame:
    """A table of video_id, frame, i, n, e, baseline and x: e less its baseline. Written, as several steps read it."""
    return cut(rolling_median(frames, window).withColumn("x", F.col("e") - F.col("baseline")), "residuals")


def quantiles(values: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """values (video_id, x) to video_id, top (the greatest) and the wanted quantiles by name, exact and linear
    between ranks. Ranks are counted over equal ranges of a timeline's values, by which the range of each
    wanted rank is found; only the values in these ranges are ordered."""
    facts = values.groupBy("video_id").agg(F.count("x").alias("_n"), F.min("x").alias("_low"), F.max("x").alias("top"))
    ranged = F.when(F.col("top") > F.col("_low"), F.least(F.floor((F.col("x") - F.col("_low")) / ((F.col("top") - F.col("_low")) / RANGES)), F.lit(RANGES - 1))).otherwise(0)
    d = values.select("video_id", "x").join(facts, "video_id").select("video_id", "x", ranged.alias("_range"))
    by = Window.partitionBy("video_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("video_id", "_range").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(by), F.lit(0)))
    at = {name: (F.col("_n") - 1) * F.lit(q) for name, q in wanted.items()}
    asked = F.array(*(F.struct(F.lit(name).alias("name"), (at[name] - F.floor(at[name])).alias("rest"), F.lit(k).alias("k"),
                               F.least(F.floor(at[name]) + k, F.col("_n") - 1).alias("rank")) for name in wanted for k in (0, 1)))
    ranks = facts.select("video_id", "top", F.inline(asked)).join(counts, "video_id")
    ranks = ranks.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_c")))
    ranks = ranks.select("video_id", "top", "name", "rest", "k", "_range", (F.col("rank") - F.col("_before")).alias("rank"))
    few = d.join(ranks.select("video_id", "_range").distinct(), ["video_id", "_range"]).groupBy("video_id", "_range", "x").agg(F.count("*").alias("_c"))
    by = Window.partitionBy("video_id", "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_before", F.coalesce(F.sum("_c").over(by), F.lit(0)))
    found = ranks.join(few, ["video_id", "_range"]).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_c")))
    pick = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("k") == k), F.col("x")))
    between = lambda name: F.max(F.when(F.col("name") == name, F.col("rest")))
    return found.groupBy("video_id").agg(F.first("top").alias("top"), *((pick(name, 0) + (pick(name, 1) - pick(name, 0)) * between(name)).alias(name) for name in wanted))


def thresholds(res: DataFrame, k: float = K_DEFAULT) -> DataFrame:
    """video_id, top, scale (interquartile range over 1.349) and threshold (k scales, a share of the top at least)."""
    d = quantiles(res, {"_q1": 0.25, "_q3": 0.75})
    d = d.select("video_id", "top", ((F.col("_q3") - F.col("_q1")) / IQR_TO_SIGMA).alias("scale"))
    return d.withColumn("threshold", F.greatest(F.lit(k) * F.col("scale"), F.lit(FLOOR_SHARE) * F.col("top")))


def peak_islands(res: DataFrame, limits: DataFrame) -> DataFrame:
    """Runs of frames over the threshold: video_id, first, last, apex (first frame of the greatest; all places), height,
    n, top."""
    d = res.join(limits.select("video_id", "top", "threshold"), "video_id").where((F.col("threshold") > 0) & (F.col("x") > F.col("threshold")))
    d = d.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("video_id").orderBy("i")))
    best = F.max_by(F.struct("i", "x"), F.struct(F.col("x"), -F.col("i")))
    return d.groupBy("video_id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), best.alias("b"), F.first("n").alias("n"), F.first("top").alias("top")).select(
        "video_id", "first", "last", F.col("b.i").alias("apex"), F.col("b.x").alias("height"), "n", "top")


def _minima(res: DataFrame, fan: int) -> list[DataFrame]:
    """Tables of video_id, node, lows, one a level: the values of a node's `fan` frames, then the minima of its nodes."""
    longest = res.agg(F.max("n")).first()[0] or 0
    rows, levels = res.select("video_id", F.col("i").alias("at"), F.col("x").alias("low")), []
    while longest > 1 or not levels:
        lows = F.sort_array(F.collect_list(F.struct("at", "low")))["low"]
        node = cut(rows.groupBy("video_id", F.floor(F.col("at") / fan).alias("node")).agg(lows.alias("lows")), "minima")
        levels.append(node)
        rows, longest = node.select("video_id", F.col("node").alias("at"), F.array_min("lows").alias("low")), -(-longest // fan)
    return levels


def nearest_low(asked: DataFrame, res: DataFrame, fan: int = FAN) -> DataFrame:
    """asked (video_id, apex, half, ...) plus left and right: the nearest places before and after the apex whose x is at
    or under half; null where there are none. Up a tree of minima until a node has one, then down to it: each
    step joins a row of asked with one node."""
    levels = _minima(res, fan)
    place = lambda where, last: (F.array_max if last else F.array_min)(F.filter(F.sequence(F.lit(0), F.size("lows") - 1), where))
    low = lambda j: F.get("lows", j) <= F.col("half")
    beside = lambda own, left: (lambda j: (j < own) & low(j)) if left else (lambda j: (j > own) & low(j))
    d = asked.withColumns({f"_{s}{c}": F.lit(None).cast("long") for s in "lr" for c in ("at", "level")})
    for k, level in enumerate(levels):
        at = F.floor(F.col("apex") / F.lit(fan**k))
        d = d.withColumn("node", F.floor(at / fan)).join(level, ["video_id", "node"])
        own = at % fan
        for side, last in (("l", True), ("r", False)):
            found = F.when(F.col(f"_{side}at").isNull(), place(beside(own, last), last) + F.col("node") * fan)
            d = d.withColumn("_found", found).withColumns({
                f"_{side}level": F.when(F.col("_found").isNotNull(), F.lit(k)).otherwise(F.col(f"_{side}level")), f"_{side}at": F.coalesce(f"_{side}at", "_found")})
        d = d.drop("node", "lows", "_found")
    for k in range(len(levels) - 1, 0, -1):
        for side, last in (("l", True), ("r", False)):
            d = d.withColumn("node", F.when(F.col(f"_{side}level") == k, F.col(f"_{side}at"))).join(levels[k - 1], ["video_id", "node"], "left")
            down = place(low, last) + F.col("node") * fan
            d = d.withColumns({f"_{side}at": F.coalesce(down, f"_{side}at"), f"_{side}level": F.when(F.col("node").isNotNull(), k - 1).otherwise(F.col(f"_{side}level"))}).drop("node", "lows")
    return d.withColumnsRenamed({"_lat": "left", "_rat": "right"}).drop("_llevel", "_rlevel")


def peaks(frames: DataFrame, frame_ms: float = FRAME_MS, k: float = K_DEFAULT, min_gap: float = MIN_GAP_SEC,
          baseline_sec: float = BASELINE_SEC) -> DataFrame:
    """frames (video_id, frame, e) to video_id, t, strength, kind: impact or crowd."""
    with scratch(frames.sparkSession) as result:
        res = residuals(frames, max(1, round(baseline_sec * 1000 / frame_ms)))
        islands = cut(peak_islands(res, thresholds(res, k)).withColumn("half", F.col("height") * 0.5), "peaks")
        d = nearest_low(islands, res)
        width = (F.coalesce("right", "n") - F.coalesce("left", F.lit(-1)) - 1) * (frame_ms / 1000)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("height") / F.col("top")))
        d = d.select("video_id", F.bround((F.col("apex") + 0.5) * frame_ms / 1000, 2).alias("t"), F.bround(share, 3).alias("strength"),
                     F.when(width <= IMPACT_SEC, "impact").otherwise("crowd").alias("kind"))
        out = cut(merge_close(d, min_gap), "merged")
        result.append(out)
    return out


def merge_close(found: DataFrame, min_gap: float) -> DataFrame:
    """Of peaks closer than min_gap to the last one kept the stronger stays, and is then the last one."""
    return chain(found, "video_id", "t", [F.col("strength"), F.col("kind")], min_gap, "strength")


def scene_cuts(scenes: DataFrame) -> DataFrame:
    """Where a scene starts, the first one aside."""
    first = F.min("scene_index").over(Window.partitionBy("video_id"))
    return scenes.withColumn("_first", first).where(F.col("scene_index") > F.col("_first")).select("video_id", F.bround("start_sec", 2).alias("t"))


def scenes_or_whole(media: DataFrame, scenes: DataFrame) -> DataFrame:
    """The detected scenes; a timeline without any is one scene, and raises if its duration is unknown."""
    d = media.join(scenes.select("video_id", "scene_index", "start_sec", "end_sec"), "video_id", "left")
    return d.select("video_id", F.coalesce("scene_index", F.lit(0)).alias("scene_index"), F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"),
                    F.coalesce("end_sec", "duration_sec", F.raise_error(F.lit("a timeline without scenes and of unknown duration")).cast("double")).alias("end_sec"))


def audio_peaks(samples: DataFrame, k: float = K_DEFAULT) -> DataFrame:
    """samples (video_id, i, x) to peaks: frames, then peaks; a timeline without samples has none."""
    return peaks(rms_frames(samples), FRAME_MS, k)


NOTE = "Peaks and cuts are advice on where to look first, not a filter: for a query, or quiet material, look at all of it."


def report(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """video_id and a JSON report of peaks and cuts, with a note on what they are for."""
    p = found.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", "strength", "kind"))).alias("peaks"))
    c = cuts.groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("cuts"))
    d = p.join(c, "video_id", "full_outer")
    none = lambda kind: F.array().cast(kind)
    return d.select("video_id", F.to_json(F.struct(
        F.coalesce("peaks", none("array<struct<t:double,strength:double,kind:string>>")).alias("peaks"),
        F.coalesce("cuts", none("array<double>")).alias("cuts"), F.lit(NOTE).alias("note"))).alias("report"))
