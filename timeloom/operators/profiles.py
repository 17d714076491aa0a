"""Editing modes: their settings, how they overlay requests, and which route a timeline takes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.schema import CATEGORIES, HINTS

# Name, sampling, least frames, shortest and longest clip, template, rolls, score kept.
PROFILES = (
    ("highlights", "hybrid", 8, 3.0, 20.0, "highlights", 3.0, 3.0, 7),
    ("talk", "hybrid", 5, 8.0, 30.0, "talk", 0.0, 0.0, None),
    ("hybrid", "hybrid", 5, 5.0, 45.0, "hybrid", 0.0, 0.0, None),
)
_SCHEMA = ("hint string, sampling string, min_frames int, min_sec double, max_sec double, template string, pre_roll double, "
           "post_roll double, min_score int")


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, _SCHEMA)


def resolve(requests: DataFrame, default_score: int) -> DataFrame:
    """Joins each request's hint to its profile (hybrid for auto and unknown ones); the profile's score
    wins over the default. Three rows, so they are broadcast."""
    known = table(requests.sparkSession)
    hint = F.lower(F.trim("hint"))
    d = requests.withColumn("hint", F.when(hint.isin("highlights", "talk"), hint).otherwise("hybrid"))
    d = d.join(F.broadcast(known), "hint", "left")
    return d.withColumn("min_score", F.coalesce("min_score", F.lit(default_score)))


def with_default(hint: Column, default: str) -> Column:
    """The request's hint, else the configured one; a configured hint that doesn't exist means auto."""
    known = default.strip().lower()
    return F.coalesce(hint, F.lit(known if known in HINTS else "auto"))


def overlaid(requests: DataFrame, default_score: int) -> DataFrame:
    """Requests (hint, min_sec, max_sec, template: what was asked for) with the profile's clip lengths and
    template over them; what else a request holds stays."""
    own = requests.drop("min_sec", "max_sec", "template")
    return resolve(own, default_score)


def asked_for(hint: Column, query: Column) -> Column:
    """What a request states: null if it states neither hint nor query, else a struct of both; a hint that
    doesn't exist raises, a blank query is none, a query without a hint goes with auto."""
    q = F.nullif(F.trim(query), F.lit(""))
    low = F.lower(hint)
    known = F.when(hint.isNull(), F.lit("auto")).when(low.isin(*HINTS), low).otherwise(F.raise_error(F.concat(F.lit("unknown hint: "), hint)).cast("string"))
    return F.when(hint.isNull() & q.isNull(), F.lit(None)).otherwise(F.struct(known.alias("hint"), q.alias("query")))


def guidance(mode: Column, texts: dict[str, str], fallback: str = "") -> Column:
    """A text by mode (blind to case and blanks), or the fallback."""
    found = F.lit(fallback)
    for name, text in texts.items():
        found = F.when(F.lower(F.trim(mode)) == name, F.lit(text)).otherwise(found)
    return found


def clip_schema() -> str:
    """The JSON schema of one clip of a reply, from the closed vocabularies."""
    text = lambda n: {"type": "string", "minLength": 1, "maxLength": n}
    return json.dumps({"type": "object", "required": ["id", "start", "end", "category", "description", "score", "rationale"], "properties": {
        "id": text(64), "start": {"type": "string"}, "end": {"type": "string"}, "category": {"enum": list(CATEGORIES)}, "description": text(500),
        "score": {"type": "integer", "minimum": 0, "maximum": 10}, "rationale": text(300), "tags": {"type": "array", "maxItems": 5, "items": {"type": "string"}}}})


def route(hint: Column, audio: Column, video: Column) -> Column:
    return F.when((hint == "talk") & audio, "audio").when(video, "video").otherwise("keyframe")


def template_for(coarse: Column, query: Column, mode: Column) -> Column:
    """coarse before query before the mode's own template."""
    q = F.nullif(F.trim(query), F.lit(""))
    return F.when(coarse, "coarse").when(q.isNotNull(), "query").when(mode.isin("highlights", "talk"), mode).otherwise("hybrid")


def frame_lines(times: DataFrame) -> DataFrame:
    """video_id, lines: one "index: clock" line a frame, in order."""
    from timeloom.functions.timecode import to_clock

    line = F.concat_ws(": ", F.col("frame_index").cast("string"), to_clock(F.col("t")))
    items = F.array_sort(F.collect_list(F.struct("frame_index", line.alias("line"))))
    return times.groupBy("video_id").agg(items.alias("i")).select("video_id", F.array_join("i.line", "\n").alias("lines"))
