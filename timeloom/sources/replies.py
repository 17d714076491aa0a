"""Replies of a model: lenient JSON, one malformed clip never costs the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom import schema as S
from timeloom.functions.text import isolate_json
from timeloom.functions.timecode import from_seconds, parse
from timeloom.functions.variants import is_number, is_object, is_text
from timeloom.functions.variants import number as _number
from timeloom.functions.variants import text_of as _text

PROMPT_VERSION = "v12"


def tags_of(v: Column) -> Column:
    """null: none; one string: itself; a list: its first five entries, nulls aside, as text."""
    listed = F.transform(F.try_variant_get(v, "$.tags", "array<variant>"), lambda t: F.try_variant_get(t, "$", "string"))
    return F.when(_text(v, "$.tags").isNotNull(), F.array(_text(v, "$.tags"))).otherwise(
        F.coalesce(F.slice(F.array_compact(listed), 1, 5), F.array().cast("array<string>")))


def parse_plans(replies: DataFrame, text: str = "raw") -> DataFrame:
    """Adds problem (null, or why the reply is no plan), clips (valid ones), dropped (how many aren't)
    and usd (the cost that the reply states) to the replies."""
    d = replies.withColumn("_v", F.try_parse_json(isolate_json(F.col(text))))
    items = F.try_variant_get("_v", "$.clips", "array<variant>")
    d = d.withColumns({
        "problem": F.when(F.col("_v").isNull(), "not JSON").when(~is_object(F.col("_v")), "not an object")
                    .when(items.isNull(), "no clips"),
        "_items": items})

    # One array after the other, as functions of array elements share no subexpressions; flat, as each struct inside a struct costs its own row.
    names = ("id", "start", "end", "category", "description", "score", "rationale", "tags")

    def found(v):
        return F.struct(*(F.try_variant_get(v, f"$.{n}", "variant").alias(n) for n in names))

    def kinds(c):
        return F.struct(*(c[n].alias(n) for n in names), *(F.schema_of_variant(c[n]).alias(f"{n}_kind") for n in names))

    def read(c):
        said = lambda n: F.when(is_text(c[f"{n}_kind"]), F.try_variant_get(c[n], "$", "string"))
        number = lambda n: F.when(is_number(c[f"{n}_kind"]), F.try_variant_get(c[n], "$", "double"))
        listed = F.when(c["tags_kind"].startswith("ARRAY"), F.slice(F.array_compact(F.try_variant_get(c["tags"], "$", "array<string>")), 1, 5))
        tags = F.when(is_text(c["tags_kind"]), F.array(said("tags"))).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
        texts = [said(n).alias(n) for n in ("id", "start", "end", "category", "description", "rationale")]
        return F.struct(*texts, *(number(n).alias(f"{n}_number") for n in ("start", "end", "score")), tags.alias("tags"))

    def clip(c):
        time = lambda n: F.when(c[n].isNotNull(), parse(c[n])).otherwise(from_seconds(c[f"{n}_number"])).alias(f"{n}_us")
        return F.struct(c["id"].alias("clip_id"), time("start"), time("end"), c["category"].alias("category"), c["description"].alias("description"),
                        c["score_number"].alias("score"), c["rationale"].alias("rationale"), c["tags"].alias("tags"))

    def valid(c):
        sized = lambda f, n: F.length(c[f]).between(1, n)
        ok = (sized("clip_id", 64) & (c["end_us"] > c["start_us"]) & c["category"].isin(*S.CATEGORIES) & sized("description", 500)
              & sized("rationale", 300) & c["score"].between(0, 10) & (c["score"] == F.floor(c["score"])))
        return F.coalesce(ok, F.lit(False))

    every = F.coalesce(F.transform(F.transform(F.transform(F.transform("_items", found), kinds), read), clip), F.array().cast(
        "array<struct<clip_id:string,start_us:bigint,end_us:bigint,category:string,description:string,score:double,rationale:string,tags:array<string>>>"))
    # A generator of one row in between: else Catalyst writes the reading of a clip out at each of its uses.
    d = d.select("*", F.inline(F.array(F.struct(every.alias("_every"))))).withColumn("clips", F.filter("_every", valid))
    d = d.withColumn("dropped", F.size("_every") - F.size("clips"))
    usd = F.try_variant_get("_v", "$.usage.cost", "double")
    return d.withColumn("usd", usd).drop("_v", "_items", "_every")


def plan_problem(text: Column) -> Column:
    """What is wrong with a reply as a whole plan, or null: its id (1 to 128 characters), its duration (over
    0), or keys that a plan doesn't have."""
    v = F.try_parse_json(isolate_json(text))
    keys = F.json_object_keys(F.to_json(v))
    odd = F.array_except(keys, F.array(*map(F.lit, ("video_id", "duration_sec", "clips", "metadata"))))
    name, seconds = _text(v, "$.video_id"), _number(v, "$.duration_sec")
    return (F.when(v.isNull(), "not JSON").when(~is_object(v), "not an object")
            .when(~F.coalesce(F.length(name).between(1, 128), F.lit(False)), "bad video_id").when(~F.coalesce(seconds > 0, F.lit(False)), "bad duration_sec")
            .when(F.size(odd) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(odd), ", "))))


def exploded(plans: DataFrame, key: str) -> DataFrame:
    """One row a valid clip: key, pos and the clip's fields."""
    d = plans.select(key, F.posexplode("clips").alias("pos", "c"))
    return d.select(key, "pos", "c.clip_id", "c.start_us", "c.end_us", "c.category", "c.description", F.col("c.score").cast("int").alias("score"), "c.rationale", "c.tags")


def stamped(metadata: Column, provider: str, model: str, seconds: Column, usd: Column) -> Column:
    """A reply's metadata (map) with our own provenance over it; the cost only where it is known."""
    own = F.create_map(
        F.lit("vlm_provider"), F.lit(provider), F.lit("vlm_model"), F.lit(model), F.lit("prompt_version"), F.lit(PROMPT_VERSION),
        F.lit("analysis_time_sec"), F.bround(seconds, 2).cast("string"))
    cost = F.when(usd.isNotNull(), F.create_map(F.lit("cost_usd"), usd.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    theirs = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.map_concat(own, cost)), k))
    return F.map_concat(theirs, own, cost)


def parse_detection(replies: DataFrame, text: str = "raw") -> DataFrame:
    """Adds content_hint, confidence, reasoning and problem (null, or what is wrong)."""
    d = replies.withColumn("_v", F.try_parse_json(isolate_json(F.col(text))))
    names = ("content_hint", "category", "content_type", "type", "label")
    hint = F.lower(F.trim(F.coalesce(*(_text(F.col("_v"), f"$.{n}") for n in names))))
    told = _text(F.col("_v"), "$.confidence")
    number = F.rtrim(F.trim(told), F.lit("%")).try_cast("double")
    confidence = F.when(told.isNotNull(), F.when(number > 1, number / 100).otherwise(number)).otherwise(_number(F.col("_v"), "$.confidence"))
    d = d.withColumns({"content_hint": hint, "confidence": confidence, "reasoning": _text(F.col("_v"), "$.reasoning")})
    known = F.coalesce(F.col("content_hint").isin(*S.HINTS[1:]), F.lit(False))
    sure = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    problem = F.when(F.col("_v").isNull(), "not JSON").when(~is_object(F.col("_v")), "not an object").when(
        ~known, "unknown hint").when(~sure, "bad confidence")
    return d.withColumn("problem", problem).drop("_v")
