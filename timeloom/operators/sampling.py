"""Which moments of a timeline to look at: uniform, per scene, hybrid, stratified."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.errors import TimelineError, UnknownName
from timeloom.functions.timecode import clocks
from timeloom.tables import cut

from .chains import chain
from .intervals import thin

# Fixed values.
UNIFORM_SEC, PER_SCENE, MAX_GAP_SEC, TOLERANCE_SEC = 2.0, 2, 3.0, 0.25
SHORT_SEC, SHORT_STEP_SEC, MIN_FRAMES = 120.0, 1.5, 3
STRATUM_PAD = 0.1


def uniform(media: DataFrame, interval: float | Column = UNIFORM_SEC) -> DataFrame:
    """media (video_id, duration_sec) to video_id, t, scene_index (null): the middle of each interval."""
    if not isinstance(interval, Column) and interval <= 0:
        raise TimelineError("interval must be over 0")
    step = interval if isinstance(interval, Column) else F.lit(float(interval))
    n = F.ceil(F.col("duration_sec") / step - 0.5).cast("int")
    d = media.where(F.col("duration_sec") > 0).select("video_id", "duration_sec", step.alias("step"), n.alias("n")).where("n > 0")
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    d = d.withColumn("t", (F.col("i") + 0.5) * F.col("step"))
    return d.where(F.col("t") < F.col("duration_sec")).select("video_id", "t", F.lit(None).cast("int").alias("scene_index"))


def _inside(scenes: DataFrame, n: Column) -> DataFrame:
    """n moments inside each scene, evenly spaced."""
    d = scenes.where(F.col("end_sec") > F.col("start_sec")).withColumn("n", n.cast("int")).where("n > 0")
    d = d.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * F.col("i") / (F.col("n") + 1)
    return d.select("video_id", t.alias("t"), "scene_index")


def per_scene(scenes: DataFrame, n: int = PER_SCENE) -> DataFrame:
    if n <= 0:
        raise TimelineError("at least one moment a scene")
    return _inside(scenes, F.lit(n))


def deduped(specs: DataFrame, tolerance: float = TOLERANCE_SEC) -> DataFrame:
    return thin(specs, "video_id", "t", [F.coalesce("scene_index", F.lit(-1))], tolerance)


def hybrid(scenes: DataFrame, media: DataFrame, n: int = PER_SCENE, max_gap: float = MAX_GAP_SEC) -> DataFrame:
    """Moments in each scene and more in long ones; timelines without scenes are sampled uniformly."""
    bare = media.join(scenes.select("video_id").distinct(), "video_id", "left_anti")
    return deduped(_hybrid(scenes, n, max_gap)).unionByName(uniform(bare, max_gap))


def _hybrid(scenes: DataFrame, n: int, max_gap: float) -> DataFrame:
    """n moments inside each scene, then as many more as a long one has room for. Scenes are gone through once and
    aren't united with themselves, so that where they are dealt by timeline their moments are too."""
    if n <= 0:
        raise TimelineError("at least one moment a scene")
    length = F.col("end_sec") - F.col("start_sec")
    extra = F.greatest(F.lit(0), F.when(length > max_gap, F.floor(length / max_gap) - n).otherwise(0).cast("int"))
    d = scenes.where(F.col("end_sec") > F.col("start_sec")).withColumn("n", extra)
    d = d.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") + n)))
    share = F.when(F.col("i") <= n, length * F.col("i") / (n + 1)).otherwise(length * (F.col("i") - n) / (F.col("n") + 1))
    return d.select("video_id", (F.col("start_sec") + share).alias("t"), "scene_index")


STRATEGIES = ("hybrid", "scene", "uniform")


def sampled(strategy: str | Column, scenes: DataFrame, media: DataFrame, min_frames: int | Column = MIN_FRAMES, n: int = PER_SCENE,
            interval: float = UNIFORM_SEC, max_gap: float = MAX_GAP_SEC) -> DataFrame:
    """The moments of each timeline by strategy; hybrid samples short ones densely; a timeline with
    fewer than min_frames is sampled anew, uniformly. strategy and min_frames may be columns of media, so that one
    plan samples timelines of several profiles; an unknown strategy raises."""
    if not isinstance(strategy, Column) and strategy not in STRATEGIES:
        raise UnknownName(f"strategy {strategy!r}: one of {', '.join(STRATEGIES)}")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    known = F.when(as_column(strategy).isin(*STRATEGIES), as_column(strategy)).otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), as_column(strategy))).cast("string"))
    asked = media.select("video_id", "duration_sec", known.alias("_strategy"), as_column(min_frames).alias("_least"))
    thick, even = [], []
    for name in STRATEGIES if isinstance(strategy, Column) else [strategy]:
        own = asked.where(F.col("_strategy") == name).select("video_id", "duration_sec")
        inside = scenes.join(own.select("video_id"), "video_id", "left_semi")
        if name == "hybrid":
            short = F.col("duration_sec") < SHORT_SEC
            thick.append(uniform(own.where(short), SHORT_STEP_SEC))
            thick.append(_hybrid(scenes.join(own.where(~short).select("video_id"), "video_id", "left_semi"), n, max_gap))
            bare = own.where(~short).join(scenes.select("video_id").distinct(), "video_id", "left_anti")
            even.append(uniform(bare, max_gap))
        elif name == "scene":
            thick.append(per_scene(inside, n))
        else:
            even.append(uniform(own, interval))
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    specs = cut(union([*([deduped(union(thick))] if thick else []), *even]), "moments")  # counted, then read again
    counts = specs.groupBy("video_id").agg(F.count("*").alias("frames"))
    few = asked.join(counts, "video_id", "left").where((F.coalesce("frames", F.lit(0)) < F.col("_least")) & (F.col("duration_sec") > 0))
    few = cut(few.select("video_id", "duration_sec", "_least"), "few")
    dense = deduped(uniform(few, F.col("duration_sec") / (F.col("_least") + 1)))
    return specs.join(few.select("video_id"), "video_id", "left_anti").unionByName(dense)


def listed(strategy: str | Column, scenes: DataFrame, media: DataFrame, min_frames: int | Column = MIN_FRAMES, n: int = PER_SCENE,
           interval: float = UNIFORM_SEC, max_gap: float = MAX_GAP_SEC) -> DataFrame:
    """video_id, n_frames and lines of sampled moments, for timelines that have any: lines as `profiles.frame_lines` has
    them, of frames as `frame_names` numbers them. The tasks that thin a timeline's moments count and list them, so
    moments are dealt once and no table of them is written."""
    asked = _asked(strategy, media, min_frames, n, interval, max_gap)
    lines = lambda d, at: chain(d, "video_id", at, [F.coalesce("scene_index", F.lit(-1))], TOLERANCE_SEC, then=(_listed, f"video_id {kind}, n_frames long, lines string"))
    kind = media.schema["video_id"].dataType.simpleString()
    specs = cut(lines(_moments(asked, scenes, n, interval, max_gap), "_at"), "frames")
    few = _few(asked, specs.select("video_id", "n_frames"))
    dense = lines(uniform(few, F.col("duration_sec") / (F.col("_least") + 1)), "t")
    return specs.join(few.select("video_id"), "video_id", "left_anti").unionByName(dense)


def _asked(strategy: str | Column, media: DataFrame, min_frames: int | Column, n: int, interval: float, max_gap: float) -> DataFrame:
    """video_id, duration_sec, _strategy, _least."""
    by_column = isinstance(strategy, Column)
    if not by_column and strategy not in STRATEGIES:
        raise UnknownName(f"strategy {strategy!r}: one of {', '.join(STRATEGIES)}")
    if n <= 0 and (by_column or strategy != "uniform"):
        raise TimelineError("at least one moment a scene")
    if (interval <= 0 and (by_column or strategy == "uniform")) or (max_gap <= 0 and (by_column or strategy == "hybrid")):
        raise TimelineError("interval must be over 0")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    known = F.when(as_column(strategy).isin(*STRATEGIES), as_column(strategy)).otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), as_column(strategy))).cast("string"))
    return media.select("video_id", "duration_sec", known.alias("_strategy"), as_column(min_frames).alias("_least"))


def _moments(asked: DataFrame, scenes: DataFrame, n: int, interval: float, max_gap: float) -> DataFrame:
    """video_id, t, scene_index, _at, before thinning. A timeline that goes by its scenes meets them, others stand alone: one
    join and no union, so that where scenes are dealt by timeline their moments are too. _at: the time by which
    to thin, for moments spaced on purpose their number, so that all stay."""
    hybrid, short = F.col("_strategy") == "hybrid", F.col("duration_sec") < SHORT_SEC
    asked = asked.withColumn("_by_scene", F.coalesce((F.col("_strategy") == "scene") | (hybrid & ~short), F.lit(False)))
    own = scenes.select(F.col("video_id").alias("_video"), "scene_index", "start_sec", "end_sec")
    d = asked.join(own, (F.col("video_id") == F.col("_video")) & F.col("_by_scene"), "left")
    met, length = F.col("_video").isNotNull(), F.col("end_sec") - F.col("start_sec")
    extra = F.greatest(F.lit(0), F.when(hybrid & (length > max_gap), F.floor(length / max_gap) - n).otherwise(0).cast("int"))
    step = F.when(F.col("_strategy") == "uniform", float(interval)).when(hybrid & short, SHORT_STEP_SEC).when(hybrid & ~short, float(max_gap))
    d = d.select("video_id", "duration_sec", "scene_index", "start_sec", met.alias("_met"), length.alias("_length"), F.when(~met, step).alias("_step"), (~met & ~(hybrid & short)).alias("_even"), F.when(met & (length > 0), extra).alias("_extra"))
    alone = F.when(F.col("duration_sec") > 0, F.ceil(F.col("duration_sec") / F.col("_step") - 0.5).cast("int"))
    d = d.withColumn("_n", F.when(F.col("_met"), F.col("_extra") + n).otherwise(alone)).where("_n > 0")
    d = d.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    share = F.when(F.col("i") <= n, F.col("_length") * F.col("i") / (n + 1)).otherwise(F.col("_length") * (F.col("i") - n) / (F.col("_extra") + 1))
    t = F.when(F.col("_met"), F.col("start_sec") + share).otherwise((F.col("i") - 0.5) * F.col("_step"))
    d = d.withColumn("t", t).where(F.col("_met") | (F.col("t") < F.col("duration_sec")))
    return d.select("video_id", "t", "scene_index", F.when(F.col("_even"), F.col("i").cast("double")).otherwise(F.col("t")).alias("_at"))


def _few(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Timelines that are to be sampled anew."""
    few = asked.join(counts, "video_id", "left").where((F.coalesce("n_frames", F.lit(0)) < F.col("_least")) & (F.col("duration_sec") > 0))
    return cut(few.select("video_id", "duration_sec", "_least"), "few")


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments (video_id, t, ...) that come timeline by timeline and in time to a row a timeline. Held are those of one
    timeline, as its lines are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            batch = batch.select(["video_id", "t"])  # noqa: PLW2901
            ends = pc.run_end_encode(batch.column(0)).run_ends.to_numpy()
            first = batch.column(0)[0].as_py()
            if held and first != held[-1].column(0)[0].as_py():
                yield _lines_of(held)
                held = []
            if len(ends) > 1:
                yield _lines_of([*held, batch.slice(0, int(ends[-2]))])
                held = []
            held.append(batch.slice(int(ends[-2]) if len(ends) > 1 else 0))
    if held:
        yield _lines_of(held)


def _lines_of(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(pieces).combine_chunks()
    runs = pc.run_end_encode(rows["video_id"].combine_chunks())
    offsets = np.concatenate(([0], runs.run_ends.to_numpy())).astype(np.int64)
    counts = np.diff(offsets)
    number = pc.cast(pa.array(np.arange(len(rows)) - np.repeat(offsets[:-1], counts)), pa.string())
    text = pc.binary_join_element_wise(number, clocks(rows["t"].to_numpy()), ": ")
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), text), "\n")
    return pa.RecordBatch.from_arrays([runs.values, pa.array(counts), lines], names=["video_id", "n_frames", "lines"])


def stratified(media: DataFrame, n: int, seed: Column) -> DataFrame:
    """n moments, one in the inner part of each of n equal strata, drawn from seed."""
    if n < 1:
        raise TimelineError("at least one stratum")
    d = media.where(F.col("duration_sec") > 0).select("video_id", "duration_sec", seed.alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    draw = (F.shiftrightunsigned(F.xxhash64("seed", "i"), 11)).cast("double") / float(1 << 53)
    width = F.col("duration_sec") / n
    t = (F.col("i") + STRATUM_PAD + draw * (1 - 2 * STRATUM_PAD)) * width
    return d.select("video_id", F.col("i").alias("stratum"), t.alias("t"))


def sheet_times(windows: DataFrame, step: float) -> DataFrame:
    """windows (video_id, start_sec, end_sec) to frame_index and t: whole steps from the start, one at least."""
    n = F.greatest(F.lit(1), F.floor((F.col("end_sec") - F.col("start_sec")) / step).cast("int"))
    d = windows.select("video_id", "start_sec", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_index"))
    return d.select("video_id", "frame_index", (F.col("start_sec") + F.col("frame_index") * step).alias("t"))


def sheet_cells(times: DataFrame, columns: int, rows: int, offset: int = 0) -> DataFrame:
    """Where on which contact sheet each frame stands; `cell` is the index burned into it."""
    i, per = F.col("frame_index"), columns * rows
    return times.withColumns({
        "cell": i + offset, "sheet": F.floor(i / per).cast("int"),
        "row": F.floor((i % per) / columns).cast("int"), "col": (i % columns).cast("int")})


def index_map(times: DataFrame) -> DataFrame:
    """video_id, index_to_sec: JSON of cell index to second, rounded to 3."""
    # Numbers are collected and sorted; texts are made of them afterwards.
    cells = F.sort_array(F.collect_list(F.struct("cell", F.bround("t", 3).alias("t"))))
    entries = F.transform(cells, lambda x: F.struct(x["cell"].cast("string"), x["t"]))
    return times.groupBy("video_id").agg(F.to_json(F.map_from_entries(entries)).alias("index_to_sec"))


def cell_times(cells: DataFrame, times: DataFrame) -> DataFrame:
    """cells (video_id, cell, ...) with `t`, the second of the frame that the cell shows; null for a cell
    that isn't on the sheets."""
    # Spark takes generated frames for as few rows as there are timelines; without the hint it may broadcast all of them.
    return cells.join(times.select("video_id", "cell", "t").hint("merge"), ["video_id", "cell"], "left")


def sheet_order(files: DataFrame) -> DataFrame:
    """Adds `at`: sheets (video_id, name) in the order of their names."""
    return files.withColumn("at", F.row_number().over(Window.partitionBy("video_id").orderBy("name")))


def frame_names(specs: DataFrame) -> DataFrame:
    """kf_<number>_s<scene>.jpg, or _su without a scene."""
    by = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "scene_index")) - 1
    scene = F.coalesce(F.format_string("s%04d", F.col("scene_index")), F.lit("su"))
    tag = F.when(F.col("scene_index").isNull(), "su").otherwise(scene)
    return specs.withColumn("frame", by).withColumn("name", F.concat(F.format_string("kf_%05d_", F.col("frame")), tag, F.lit(".jpg")))
