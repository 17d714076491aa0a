"""Long timelines in overlapping chunks: splitting, re-basing, merging, coarse to fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.errors import AllBatchesFailed, CostRefused, TimelineError
from timeloom.functions.pricing import media_cost, sum_or_null
from timeloom.functions.text import join_key

from .intervals import suppress_iou

# Batch lengths, and the bounds of the two-pass analysis.
VIDEO_BATCH, AUDIO_BATCH = 300.0, 600.0
MIN_CHUNK = 30.0
COARSE_SCORE, COARSE_KEEP, PAD_SEC, TWO_PASS_FROM = 5, 40, 20.0, 60.0


def split(media: DataFrame, chunk: float, overlap: float | Column = 0.0) -> DataFrame:
    """media (video_id, duration_sec) to video_id, chunk_index, start_sec, end_sec. A timeline no longer
    than a chunk has none."""
    if chunk < MIN_CHUNK or (not isinstance(overlap, Column) and not 0 <= overlap < chunk):
        raise TimelineError(f"chunk from {MIN_CHUNK} s; overlap from 0, under chunk")
    over = overlap if isinstance(overlap, Column) else F.lit(float(overlap))
    n = F.ceil(F.greatest(F.lit(0.0), (F.col("duration_sec") - chunk - over) / chunk)).cast("int")
    d = media.where(F.col("duration_sec") > chunk).select("video_id", "duration_sec", over.alias("over"), F.explode(F.sequence(F.lit(0), n)).alias("chunk_index"))
    start = F.col("chunk_index") * chunk
    return d.select("video_id", "chunk_index", start.alias("start_sec"), F.least("duration_sec", start + chunk + F.col("over")).alias("end_sec"))


def batches(media: DataFrame, audio: bool, max_clip_sec: float | Column) -> DataFrame:
    """Chunks to send: overlapping by half the longest clip; a short timeline is one batch of its own."""
    size = AUDIO_BATCH if audio else VIDEO_BATCH
    longest = max_clip_sec if isinstance(max_clip_sec, Column) else F.lit(float(max_clip_sec))
    over = F.least(F.greatest(F.lit(0.0), longest / 2), F.lit(size / 2))
    short = media.where(F.col("duration_sec") <= size).select(
        "video_id", F.lit(0).alias("chunk_index"), F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"))
    return split(media, size, over).unionByName(short)


def rebase(clips: DataFrame, chunks: DataFrame) -> DataFrame:
    """Clips of chunks (times from the chunk's start) on the whole timeline; ids name their chunk. A clip
    of a chunk that isn't there raises."""
    d = clips.join(chunks.select("video_id", "chunk_index", "start_sec"), ["video_id", "chunk_index"], "left")
    return on_timeline(d)


def on_timeline(d: DataFrame) -> DataFrame:
    """As rebase, for clips that bring their chunk's start_sec along."""
    shift = F.when(F.col("start_sec").isNotNull(), F.round(F.col("start_sec") * 1_000_000).cast("long")).otherwise(
        F.raise_error(F.lit("a clip of an unknown chunk")).cast("long"))
    return d.withColumns({
        "start_us": F.col("start_us") + shift, "end_us": F.col("end_us") + shift,
        "clip_id": join_key([F.lit("c"), F.col("chunk_index").cast("string"), F.lit("_"), F.col("clip_id")])}).drop("start_sec")


def merge_clips(clips: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One list a video: of clips that are the same moment (IoU) the best stays; `place` counts in time."""
    order = [-F.col("score"), F.col("start_us"), F.col("chunk_index"), F.col("pos")]
    kept = suppress_iou(clips, "video_id", "start_us", "end_us", order, threshold)
    by = Window.partitionBy("video_id").orderBy("start_us", -F.col("score"), "chunk_index", "pos")
    return kept.withColumn("place", F.row_number().over(by))


def merge_metadata(plans: DataFrame) -> DataFrame:
    """plans (video_id, chunk_index, provider, model, prompt_version, analysis_time_sec, cost_usd): the
    first chunk's provenance; sums are null as soon as one chunk's figure is."""
    head = F.min_by(F.struct("provider", "model", "prompt_version"), "chunk_index").alias("head")
    d = plans.groupBy("video_id").agg(head, sum_or_null(F.col("analysis_time_sec")).alias("analysis_time_sec"),
                                      sum_or_null(F.col("cost_usd")).alias("cost_usd"), F.count("*").alias("n_chunks"))
    return d.select("video_id", "head.*", "analysis_time_sec", "cost_usd", "n_chunks")


def outcomes(results: DataFrame) -> DataFrame:
    """results (video_id, chunk_index, error, ...) to a row a timeline: video_id, status (done, partial: some batches are
    lost, failed: all are), n_batches, n_lost and reason, the first lost batch's error."""
    lost = F.col("error").isNotNull()
    d = results.groupBy("video_id").agg(F.count("*").alias("n_batches"), F.count_if(lost).alias("n_lost"), F.min_by("error", F.when(lost, F.col("chunk_index"))).alias("reason"))
    status = F.when(F.col("n_lost") == 0, "done").when(F.col("n_lost") < F.col("n_batches"), "partial").otherwise("failed")
    return d.select("video_id", status.alias("status"), "n_batches", "n_lost", "reason")


def surviving(results: DataFrame, strict: bool = True) -> DataFrame:
    """results (video_id, chunk_index, error, ...): those without an error. strict: a video with no chunk left
    raises when the rows are read; else it has no rows, and `outcomes` tells."""
    good = F.col("error").isNull()
    if not strict:
        return results.where(good).drop("error")
    d = results.withColumn("_good", F.count_if(good).over(Window.partitionBy("video_id")))
    alive = F.when(F.col("_good") > 0, good).otherwise(
        F.raise_error(F.concat(F.lit(f"{AllBatchesFailed.__name__}: "), F.col("video_id").cast("string"))).cast("boolean"))
    return d.where(alive).drop("error", "_good")


def candidates(clips: DataFrame, durations: DataFrame) -> DataFrame:
    """Coarse clips worth a second look: the best of each video, padded inside the timeline."""
    by = Window.partitionBy("video_id").orderBy(-F.col("score"), "start_us", "pos")
    d = clips.where(F.col("score") >= COARSE_SCORE).withColumn("place", F.row_number().over(by)).where(F.col("place") <= COARSE_KEEP)
    d = d.join(durations.select("video_id", "duration_sec"), "video_id")
    lo = F.greatest(F.lit(0.0), F.col("start_us") / 1_000_000 - PAD_SEC)
    hi = F.least("duration_sec", F.col("end_us") / 1_000_000 + PAD_SEC)
    return d.select("video_id", "place", lo.alias("lo_sec"), hi.alias("hi_sec")).where("hi_sec > lo_sec")


def two_pass(enabled: Column, force: Column, duration_sec: Column) -> Column:
    return enabled & (force | (duration_sec > TWO_PASS_FROM))


def estimates(media: DataFrame, audio: bool, passes: Column) -> DataFrame:
    return media.select("video_id", media_cost(F.col("duration_sec"), F.lit(audio), passes).alias("estimate_usd"))


def check_cost(estimate: DataFrame, cap: float, enabled: bool = False, confirm=None) -> None:
    """Raises if the sum of estimate_usd is over cap and confirm (given the sum) doesn't agree. Off unless enabled."""
    if enabled:
        total = estimate.agg(F.coalesce(F.sum("estimate_usd"), F.lit(0.0))).first()[0]
        if total > cap and not (confirm and confirm(total)):
            raise CostRefused(f"estimated {total:.4f} USD, the cap is {cap:.4f}")

