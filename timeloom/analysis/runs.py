"""From media facts to ranked plans: segments are asked about, re-based, merged, refined and ranked.

Every run takes many timelines at once. media: video_id, duration_sec and, from a profile, max_sec.
"""

from __future__ import annotations

import dataclasses
import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.errors import TimelineError
from timeloom.functions.pricing import add_known, image_cost, media_cost
from timeloom.operators import catalogue, chunks, profiles, ranking, sampling
from timeloom.plans import documents
from timeloom.sources import probe, replies
from timeloom.tables import cut

from . import models

# Longest coarse clip; frames of a detection and their least number.
COARSE_MAX_SEC = 60.0
DETECTION_FRAMES, LEAST_FRAMES = 5, 3
PASSES = 2.0
NO_FRAMES = "no frames"


@dataclasses.dataclass
class Found:
    """clips (video_id, chunk_index, pos, clip_id, start_us, end_us, score, ...) on whole timelines;
    metadata, a row a timeline: provenance, known costs, the estimate made before; outcomes, a row a timeline
    that was asked about, as `chunks.outcomes` has them."""

    clips: DataFrame
    metadata: DataFrame
    outcomes: DataFrame

    def plus(self, other: Found) -> Found:
        return Found(*(getattr(self, f.name).unionByName(getattr(other, f.name)) for f in dataclasses.fields(self)))


class Run(NamedTuple):
    """Ranked clips, plans (video_id, plan) and outcomes, where files that can't be probed count as failed."""

    ranked: DataFrame
    plans: DataFrame
    outcomes: DataFrame


def _merged(answers: DataFrame, model: models.Model, results: DataFrame) -> Found:
    good = answers.where("error is null")
    rows = good.select("video_id", "chunk_index", "start_sec", F.posexplode("clips").alias("pos", "c"))
    rows = rows.select("video_id", "chunk_index", "start_sec", "pos", "c.clip_id", "c.start_us", "c.end_us", "c.category", "c.description", F.col("c.score").cast("int").alias("score"), "c.rationale", "c.tags")
    clips = chunks.merge_clips(chunks.on_timeline(rows))
    plans = good.select("video_id", "chunk_index", F.lit(model.provider).alias("provider"), F.lit(model.model).alias("model"), F.lit(replies.PROMPT_VERSION).alias("prompt_version"),
                        F.lit(None).cast("double").alias("analysis_time_sec"), F.col("paid").alias("cost_usd"))
    return Found(clips, chunks.merge_metadata(plans), chunks.outcomes(results))


def batched(media: DataFrame, model: models.Model, audio: bool, template: Column | None = None, max_sec: Column | None = None, strict: bool = True) -> Found:
    """One pass: batches of each timeline are asked about, failed ones skipped, the rest merged. A timeline without any
    left raises if strict, else only its outcome tells."""
    longest = F.col("max_sec") if max_sec is None else max_sec
    segments = chunks.batches(media, audio, longest)
    answers = _paid(segments, F.lit("hybrid") if template is None else template, model).select("video_id", "chunk_index", "start_sec", "clips", "paid", "error")
    alive = chunks.surviving(answers, strict)
    return _merged(alive.withColumn("error", F.lit(None).cast("string")), model, answers)


def _paid(segments: DataFrame, template: Column, model: models.Model) -> DataFrame:
    """Answers, read, with `paid`: the cost that the model told. A table, as clips, metadata, outcomes and what is asked next
    all go by it, and each would read all replies anew."""
    # What was asked with isn't written beside the answer.
    told = models.replies(segments.withColumn("template", template), model, keep=lambda d, label: cut(d.drop("lines"), label))
    d = told.withColumnRenamed("usd", "paid").withColumnRenamed("error", "failure")
    p = replies.parse_plans(d)
    return cut(p.select("video_id", "chunk_index", "start_sec", "end_sec", "clips", "paid", F.coalesce("failure", "problem").alias("error")), "answers")


def two_pass(media: DataFrame, model: models.Model, audio: bool, template: Column | None = None, strict: bool = True) -> Found:
    """Coarse, then fine: the best coarse clips, padded, are asked about alone. A timeline without a
    candidate, or whose candidates all fail, keeps its coarse clips."""
    coarse = batched(media, model, audio, F.lit("coarse"), F.least(F.lit(COARSE_MAX_SEC), F.col("duration_sec")), strict)
    coarse = dataclasses.replace(coarse, clips=cut(coarse.clips, "coarse"))
    wanted = chunks.candidates(coarse.clips, media).select(
        "video_id", (F.col("place") - 1).cast("int").alias("chunk_index"), F.col("lo_sec").alias("start_sec"), F.col("hi_sec").alias("end_sec"))
    answers = _paid(wanted, F.lit("hybrid") if template is None else template, model)
    fine = _merged(answers, model, answers)
    done = fine.metadata.select("video_id")
    clips = fine.clips.unionByName(coarse.clips.join(done, "video_id", "left_anti"))
    before = coarse.metadata.select("video_id", F.col("cost_usd").alias("coarse_usd"))
    paid = fine.metadata.join(before, "video_id").withColumn("cost_usd", add_known(F.col("coarse_usd"), F.col("cost_usd"))).drop("coarse_usd")
    both = coarse.outcomes.withColumn("fine", F.lit(False)).unionByName(fine.outcomes.withColumn("fine", F.lit(True)))
    dead = F.bool_or(~F.col("fine") & (F.col("status") == "failed"))
    told = both.groupBy("video_id").agg(
        F.when(dead, "failed").when(F.sum("n_lost") > 0, "partial").otherwise("done").alias("status"), F.sum("n_batches").alias("n_batches"), F.sum("n_lost").alias("n_lost"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("fine"))).alias("reason"))
    return Found(clips, paid.unionByName(coarse.metadata.join(done, "video_id", "left_anti")), told)


def analyse(media: DataFrame, model: models.Model, audio: bool, refine: bool = False, force: bool = False, cap: float | None = None,
            confirm=None, template: Column | None = None, strict: bool = True) -> Found:
    """Video or audio analysis. refine: two passes for timelines long enough (force: for all). cap: what
    the estimate of all may come to, else confirm(estimate) decides. Durations must be over 0. strict: one timeline
    without an answer makes the reading of all clips fail; else its outcome tells, and the others have theirs."""
    d = media.withColumn("duration_sec", F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.raise_error(F.lit("duration_sec must be over 0")).cast("double")))
    twice = chunks.two_pass(F.lit(refine), F.lit(force), F.col("duration_sec"))
    d = d.withColumn("_twice", twice)
    estimates = d.select("video_id", media_cost(F.col("duration_sec"), F.lit(audio), F.when(F.col("_twice"), PASSES).otherwise(1.0)).alias("estimate_usd"))
    if cap is not None:
        chunks.check_cost(estimates, cap, True, confirm)
    found = batched(d.where("not _twice").drop("_twice"), model, audio, template, strict=strict)
    if refine:
        found = found.plus(two_pass(d.where("_twice").drop("_twice"), model, audio, template, strict))
    return dataclasses.replace(found, metadata=found.metadata.join(estimates, "video_id"))


def by_keyframes(media: DataFrame, scenes: DataFrame, model: models.Model, strict: bool = True) -> Found:
    """Timelines whose model neither sees nor hears them: one request each over frames sampled by its profile
    (media: sampling, min_frames). The estimate is that of so many images. A timeline without frames raises if
    strict, else counts as failed. metadata also has n_frames and n_scenes."""
    inside = scenes.join(media.select("video_id"), "video_id", "left_semi")
    frames = sampling.listed(F.col("sampling"), scenes, media, F.col("min_frames"))
    facts = media.select("video_id", "duration_sec").join(frames.select("video_id", "n_frames"), "video_id", "left").join(inside.groupBy("video_id").agg(F.count("*").alias("n_scenes")), "video_id", "left")
    facts = cut(facts.withColumns({"n_frames": F.coalesce("n_frames", F.lit(0)), "n_scenes": F.coalesce("n_scenes", F.lit(0))}), "facts")
    if strict:
        known = F.when(F.col("n_frames") > 0, F.col("n_frames")).otherwise(F.raise_error(F.concat(F.lit(f"{NO_FRAMES}: "), F.col("video_id").cast("string"))).cast("long"))
        facts = facts.withColumn("n_frames", known)
    bare = facts.where("n_frames = 0").select("video_id", F.lit(0).alias("chunk_index"), F.lit(NO_FRAMES).alias("error"))
    whole = facts.where("n_frames > 0").join(frames.select("video_id", "lines"), "video_id").select("video_id", F.lit(0).alias("chunk_index"), F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"), "lines")
    answers = _paid(whole, F.lit("hybrid"), model)
    results = answers.select("video_id", "chunk_index", "error").unionByName(bare)
    found = _merged(chunks.surviving(answers, strict).withColumn("error", F.lit(None).cast("string")), model, results)
    price = lambda usd: F.lit(usd).cast("double")
    usd = image_cost(F.col("n_frames"), price(getattr(model, "usd_in", None)), price(getattr(model, "usd_out", None)))
    estimates = facts.select("video_id", "n_frames", "n_scenes", usd.alias("estimate_usd"))
    return dataclasses.replace(found, metadata=found.metadata.join(estimates, "video_id"))


def detect_hints(media: DataFrame, model: models.Model, n: int = DETECTION_FRAMES) -> DataFrame:
    """video_id, content_hint, confidence, reasoning, problem: the model's guess from n stratified frames."""
    if n < LEAST_FRAMES:
        raise TimelineError(f"at least {LEAST_FRAMES} frames")
    frames = sampling.stratified(media, n, F.col("video_id"))
    lines = profiles.frame_lines(frames.select("video_id", F.col("stratum").alias("frame_index"), "t"))
    asked = media.join(lines, "video_id").select("video_id", F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"), F.lit("detect").alias("template"), "lines")
    return replies.parse_detection(models.replies(asked, model)).select("video_id", "content_hint", "confidence", "reasoning", F.coalesce("error", "problem").alias("problem"))


def complete(found: Found, media: DataFrame, max_clips: int = 20) -> tuple[DataFrame, DataFrame]:
    """Ranked clips, and a JSON plan for each timeline that has one: the profile's least score, the rolls
    inside the times, provenance and sampling beside the clips. media: as described, with pre_roll,
    post_roll, min_score, route and sampling."""
    own = media.select("video_id", F.col("min_score").alias("_least"))
    ranked = ranking.rank(found.clips.drop("place").join(own, "video_id"), F.col("_least"), max_clips).drop("_least")
    facts = media.join(found.metadata, "video_id", "left")
    sampled = F.col("route") == "keyframe"
    extra = {
        "vlm": F.struct(F.col("provider"), F.col("model"), F.col("prompt_version"), F.col("analysis_time_sec"),
                        F.when(sampled, F.col("estimate_usd")).otherwise(F.col("cost_usd")).alias("cost_estimate_usd"), F.col("estimate_usd").alias("cost_upfront_estimate_usd")),
        "sampling": F.struct(F.when(sampled, F.col("sampling")).otherwise(F.col("route")).alias("strategy"),
                             F.coalesce("n_frames", F.lit(0)).alias("n_keyframes"), F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"))}
    return ranked, documents.write_plan(ranked, facts, F.col("pre_roll"), F.col("post_roll"), extra)


def run_all(requests: DataFrame, scenes: DataFrame, model: models.Model, default_score: int = 5, refine: bool = False, strict: bool = False) -> Run:
    """requests (video_id, path, payload: a prober's JSON, hint) to ranked clips, plans and outcomes: probe, profile,
    route, ask, rank, write. A file that can't be probed, has no length or no frames, or whose batches all fail, costs
    no other: it has a failed outcome with the reason. strict: it raises when rows are read."""
    # Requests come along, whatever their paths, and are a table: each step that follows goes by it, and would probe all anew.
    facts = probe.parse_probe(requests.select("path", "payload", F.struct("video_id", "hint").alias("_own")), keep="_own").select("_own.*", "*").drop("_own")
    problem = F.coalesce("problem", F.when(~F.coalesce(F.col("duration_sec") > 0, F.lit(False)), "no duration"))
    facts = profiles.resolve(facts.withColumn("problem", problem), default_score)
    facts = cut(facts.withColumn("route", profiles.route(F.col("hint"), F.lit(model.hears), F.lit(model.sees))), "media")
    if strict:
        facts = facts.withColumn("duration_sec", F.when(F.col("problem").isNull(), F.col("duration_sec")).otherwise(F.raise_error(F.concat_ws(": ", "path", "problem")).cast("double")))
        media = facts.drop("problem")
    else:
        media = facts.where("problem is null").drop("problem")
    parts = [] if model.sees else [by_keyframes(media.where("route = 'keyframe'"), scenes, model, strict)]
    for kind, able in (("video", model.sees), ("audio", model.hears)):
        if able:
            more = analyse(media.where(F.col("route") == kind), model, kind == "audio", refine, template=F.lit("hybrid"), strict=strict)
            parts.append(dataclasses.replace(more, metadata=more.metadata.withColumns({"n_frames": F.lit(0).cast("long"), "n_scenes": F.lit(0).cast("long")})))
    found = functools.reduce(Found.plus, parts)
    unread = facts.where("problem is not null").select("video_id", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("n_batches"), F.lit(0).cast("long").alias("n_lost"), F.col("problem").alias("reason"))
    return Run(*complete(found, media), found.outcomes.unionByName(unread))


def run(requests: DataFrame, scenes: DataFrame, model: models.Model, default_score: int = 5, refine: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """As run_all, without the outcomes; strict unless told otherwise."""
    return run_all(requests, scenes, model, default_score, refine, strict)[:2]


def require_capable(asked: DataFrame, raw_models: DataFrame) -> DataFrame:
    """asked (id); raises when rows are read that name a model which won't do."""
    d = catalogue.check_models(asked, raw_models)
    return d.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "id", "problem")).cast("boolean"))).select("id")


def summary(ranked: DataFrame, metadata: DataFrame) -> DataFrame:
    """A row a timeline with clips: n_clips, seconds, best score, provider, model, cost."""
    d = ranked.groupBy("video_id").agg(F.count("*").alias("n_clips"), (F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds"), F.max("final_score").alias("best"))
    return d.join(metadata.select("video_id", "provider", "model", "cost_usd"), "video_id", "left")


def cuts_from(plans: DataFrame, key: str, min_score: int = 0, strict: bool = True) -> DataFrame:
    """plans (key, text) to the cuts to make: key, place, start_us, end_us and the file's name. A plan that can't be
    read raises if strict, else it has none."""
    from timeloom.functions.text import clip_filename

    d = ranking.numbered(documents.read_clips(plans, key, min_score, strict), ("pos",), key, "place")
    return d.select(key, "place", "start_us", "end_us", clip_filename(F.col("final_score"), F.col("place"), F.col("description")).alias("file"))
