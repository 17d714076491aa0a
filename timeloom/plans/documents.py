"""Plans and manifests: JSON documents of a timeline's clips, written, read, filtered, ordered."""

from __future__ import annotations

import functools
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom import schema as S
from timeloom.errors import UnknownName
from timeloom.functions.scores import final_score
from timeloom.functions.timecode import from_seconds, parse, parse_lenient, to_clock
from timeloom.functions.variants import is_object, opened
from timeloom.tables import cut, scratch

# As read: numbers of any kind, cut to whole scores later.
_CLIP = ("rank double, id string, start string, end string, duration_sec double, category string, description string, rationale string, "
         "vlm_score double, heuristic_score double, final_score double, tags array<string>")
_CLIP_ROW = ("struct<clip_id:string,start_us:bigint,end_us:bigint,category:string,description:string,rationale:string,score:int,heuristic_score:int,"
             "final_score:int,tags:array<string>>")
_FIELDS = ("id", "start", "end", "category", "description", "rationale", "vlm_score", "heuristic_score", "final_score", "tags")
# Fixed value: the rationale of a clip without one.
RATIONALE = "from plan.json"
_VIDEO = "path string, duration_sec double, width int, height int, fps double, video_codec string, audio_codec string, container string, size_bytes long"
DOCUMENT = f"video struct<{_VIDEO.replace(' ', ':').replace(',:', ',')}>, clips array<struct<{_CLIP.replace(' ', ':').replace(',:', ',')}>>, outputs map<string,array<string>>"


def write_plan(ranked: DataFrame, media: DataFrame, before: float | Column = 0.0, after: float | Column = 0.0, extra: dict[str, Column] | None = None) -> DataFrame:
    """One JSON plan a video: its clips in rank order, the rolls inside the times. Videos without a
    ranked clip have none. extra: further blocks by name, of media's columns; they win over our own."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    blocks = F.struct(*(c.alias(n) for n, c in (extra or {}).items()), F.lit(None).alias("_"))
    own = media.select("video_id", F.struct(*S.MEDIA.names).alias("video"), as_column(before).alias("_before"), as_column(after).alias("_after"), blocks.alias("_blocks"))
    d = ranked.join(own, "video_id")
    start = F.greatest(F.lit(0.0), F.col("start_us") / 1e6 - F.col("_before"))
    end = F.least(F.col("video.duration_sec"), F.col("end_us") / 1e6 + F.col("_after"))
    clip = F.struct(
        "rank", F.col("clip_id").alias("id"), to_clock(start).alias("start"), to_clock(end).alias("end"), F.bround(end - start, 3).alias("duration_sec"),
        "category", "description", "rationale", F.col("score").alias("vlm_score"), "heuristic_score", "final_score", "tags")
    d = d.groupBy("video_id").agg(F.first("video").alias("video"), F.array_sort(F.collect_list(clip)).alias("clips"), F.first("_blocks").alias("_blocks"))
    names = {"video": F.col("video"), "clips": F.col("clips")} | {n: F.col("_blocks")[n] for n in extra or {}}
    return once(d.select("video_id", F.to_json(F.struct(*(c.alias(n) for n, c in names.items()))).alias("plan")), "plan")


def write_manifest(ranked: DataFrame, media: DataFrame, outputs: DataFrame) -> DataFrame:
    """One JSON manifest a video, clips or not; outputs (video_id, mode, place, path)."""
    clip = F.struct(
        "rank", F.col("clip_id").alias("id"), to_clock(F.col("start_us") / 1e6).alias("start"), to_clock(F.col("end_us") / 1e6).alias("end"),
        F.bround((F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("duration_sec"), "category", "description",
        F.col("score").alias("vlm_score"), "heuristic_score", "final_score", "tags")
    clips = ranked.groupBy("video_id").agg(F.array_sort(F.collect_list(clip)).alias("clips"))
    by_mode = outputs.groupBy("video_id", "mode").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("p"))
    by_mode = by_mode.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", F.col("p.path").alias("paths"))))).alias("outputs"))
    fields = [c for c in S.MEDIA.names if c not in ("container", "size_bytes")]
    d = media.select("video_id", F.struct(*fields).alias("video")).join(clips, "video_id", "left").join(by_mode, "video_id", "left")
    text = F.to_json(F.struct(
        "video", F.coalesce("clips", F.array().cast(clips.schema["clips"].dataType)).alias("clips"),
        F.coalesce("outputs", F.create_map().cast("map<string,array<string>>")).alias("outputs")))
    return once(d.select("video_id", text.alias("manifest")), "manifest")


def once(d: DataFrame, column: str) -> DataFrame:
    """d as it is, with a column that later filters and columns share instead of working it out anew: they would be
    moved below it, but aren't moved below a generator (of one row). Nothing else changes but the column's place."""
    return d.select(*(c for c in d.columns if c != column), F.inline(F.array(F.struct(column))))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Plan or manifest files as (path, document, text); a file that isn't JSON raises when it is read."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    sound = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col("path"))).cast("string"))
    return parse_documents(d.withColumn("text", sound), "text")


def parse_documents(texts: DataFrame, column: str) -> DataFrame:
    """Replaces a JSON column by `document`, as far as it has a document's shape, and `text`, as it is."""
    d = texts.withColumns({"document": F.from_json(column, DOCUMENT), "text": F.col(column)})
    return d if column == "text" else d.drop(column)


def _whole(score: Column) -> Column:
    return score.cast("int")


def _said(f: Column) -> Column:
    """Whether a field is there and neither null, empty, false nor 0."""
    empty = F.to_json(f["v"]).isin("false", "[]", "{}") | (f["number"] == 0)
    other = F.coalesce(f["kind"] != "VOID", F.lit(False)) & ~F.coalesce(empty, F.lit(False))
    return F.when(f["text"].isNotNull(), f["text"] != "").otherwise(other)


def _score(f: Column) -> Column:
    """Numbers are cut to whole ones; true and false count as 1 and 0; other kinds give null."""
    flag = F.when(f["kind"] == "BOOLEAN", F.try_variant_get(f["v"], "$", "boolean").cast("int"))
    return F.coalesce(_whole(f["number"]), flag)


def _sized(c: Column, most: int) -> Column:
    return F.coalesce(F.length(c).between(1, most), F.lit(False))


def _tags(f: Column) -> Column:
    """At most five entries as text; null if tags are neither a list, a text nor null."""
    entry = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    items = F.filter(F.try_variant_get(f["v"], "$", "array<variant>"), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    none = F.array().cast("array<string>")
    kind = F.coalesce(f["kind"], F.lit("VOID"))
    return F.when(kind == "VOID", none).when(kind == "STRING", F.array(f["text"])).when(kind.startswith("ARRAY"), F.slice(F.transform(items, entry), 1, 5))


def _reached(c: Column) -> Column:
    """The score that decides whether a clip is taken."""
    return F.coalesce(_score(c["final_score"]), final_score(F.coalesce(_score(c["vlm_score"]), F.lit(0)), F.coalesce(_score(c["heuristic_score"]), F.lit(5))))


def _clip(c: Column, number_: Column) -> Column:
    """A clip's fields (as opened) with defaults for what is missing."""
    final = _score(c["final_score"])
    vlm = F.coalesce(_score(c["vlm_score"]), final, F.lit(0))
    heuristic = F.coalesce(_score(c["heuristic_score"]), F.lit(5))
    or_else = lambda f, text: F.when(_said(f), f["text"]).otherwise(F.lit(text))
    time = lambda f: F.coalesce(parse(f["text"]), from_seconds(f["number"]))
    fields = {
        "clip_id": F.when(_said(c["id"]), F.coalesce(c["id"]["text"], F.to_json(c["id"]["v"]))).otherwise(F.concat(F.lit("clip_"), number_.cast("string"))),
        "start_us": time(c["start"]), "end_us": time(c["end"]),
        "category": F.when(c["category"]["kind"].isNull(), "highlight").otherwise(c["category"]["text"]),
        "description": or_else(c["description"], "clip"), "rationale": or_else(c["rationale"], RATIONALE),
        "score": vlm, "heuristic_score": heuristic, "final_score": F.coalesce(final, final_score(vlm, heuristic)), "tags": _tags(c["tags"])}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _bad(c: Column) -> Column:
    """The first field of a clip that won't do, or null."""
    ok = lambda x: F.coalesce(x, F.lit(False))
    checks = {"id": _sized(c["clip_id"], 64), "times": ok(c["end_us"] > c["start_us"]), "category": ok(c["category"].isin(*S.CATEGORIES)), "description": _sized(c["description"], 500),
              "score": ok(c["score"].between(0, 10)), "rationale": _sized(c["rationale"], 300), "tags": c["tags"].isNotNull()}
    return functools.reduce(lambda out, name: out.when(~checks[name], name), checks, F.when(F.lit(False), ""))


def _video_problem(video: Column) -> Column:
    """Which field of the video block (a variant) won't do, or null."""
    names = ("path", "duration_sec", "width", "height", "fps", "video_codec", "audio_codec", "container", "size_bytes")
    odd = F.array_except(F.json_object_keys(F.to_json(video)), F.array(*map(F.lit, names)))

    def judged(c):
        value = lambda f: F.coalesce(c[f]["number"], c[f]["text"].try_cast("double"))
        whole = lambda f, least: (value(f) >= least) & (value(f) == F.floor(value(f)))
        text = lambda f: c[f]["text"].isNotNull()
        checks = {"path": text("path"), "duration_sec": value("duration_sec") > 0, "width": whole("width", 1), "height": whole("height", 1), "fps": value("fps") > 0, "video_codec": text("video_codec"),
                  "audio_codec": F.coalesce(c["audio_codec"]["kind"], F.lit("VOID")).isin("VOID", "STRING"), "container": text("container"), "size_bytes": whole("size_bytes", 0)}
        found = functools.reduce(lambda out, name: out.when(~F.coalesce(checks[name], F.lit(False)), name), checks, F.when(F.lit(False), ""))
        return found.when(F.size(odd) > 0, F.array_join(F.array_sort(odd), ", "))

    return F.get(F.transform(opened(F.array(video), names), judged), F.lit(0))


def judged_plans(documents: DataFrame, key: str, min_score: int = 0) -> DataFrame:
    """documents (key, text) to key, problem and clips: what of a plan reaches min_score. Entries that aren't objects are
    skipped. A document that is no plan, or one clip that reaches min_score and isn't valid, spoils the plan: problem
    says why, and it has no clips."""
    # Generators of one row: what is read once isn't written out again at each use.
    d = documents.select(key, F.inline(F.array(F.struct(F.try_parse_json("text").alias("_v")))))
    parts = F.struct(F.try_variant_get("_v", "$.video", "variant").alias("_video"), F.try_variant_get("_v", "$.clips", "array<variant>").alias("_items"))
    d = d.select(key, "_v", F.inline(F.array(parts)))
    d = d.select(key, "_v", "_video", "_items", F.inline(F.array(F.struct(_video_problem(F.col("_video")).alias("_odd")))))
    problem = (F.when(F.col("_v").isNull(), "not JSON").when(~is_object(F.col("_v")), "not an object")
               .when(~is_object(F.col("_video")), "no video").when(F.col("_odd").isNotNull(), F.concat(F.lit("bad video: "), F.col("_odd")))
               .when(F.col("_items").isNull(), "no clips"))
    enough = F.filter(opened(F.filter("_items", lambda x: is_object(x)), _FIELDS), lambda c: _reached(c) >= min_score)
    clips = F.transform(enough, lambda c, i: _clip(c, i + 1))
    d = d.select(key, F.inline(F.array(F.struct(problem.alias("_problem"), F.coalesce(clips, F.array().cast(f"array<{_CLIP_ROW}>")).alias("_clips")))))
    bad = F.get(F.filter(F.transform("_clips", _bad), lambda b: b.isNotNull()), F.lit(0))
    d = d.select(key, "_clips", F.inline(F.array(F.struct(F.coalesce("_problem", F.concat(F.lit("bad clip: "), bad)).alias("problem")))))
    return d.select(key, "problem", F.when(F.col("problem").isNull(), F.col("_clips")).otherwise(F.array().cast(f"array<{_CLIP_ROW}>")).alias("clips"))


def read_clips(documents: DataFrame, key: str, min_score: int = 0, strict: bool = True) -> DataFrame:
    """Clips of plans that reach min_score, with defaults for what is missing. A plan with a problem raises if strict,
    else it has no clips, and `judged_plans` tells."""
    d = judged_plans(documents, key, min_score)
    if strict:
        d = d.withColumn("clips", F.when(F.col("problem").isNull(), F.col("clips")).otherwise(F.raise_error(F.concat(F.when(F.col("problem").startswith("bad clip"), "invalid clip in a plan: ").otherwise("invalid plan: "), F.col("problem"))).cast(f"array<{_CLIP_ROW}>")))
    d = d.select(key, F.posexplode("clips").alias("pos", "c"))
    return d.select(key, "pos", "c.*")


def select_outputs(documents: DataFrame, key: str, min_score: int, order: str) -> DataFrame:
    """Paths of a manifest's separate outputs whose clips reach min_score, with `at`, their place in
    order: chronological, score-desc or manifest. Clips and outputs that don't match in number raise."""
    orders = {"chronological": [F.col("start_us")], "score-desc": [-F.col("final_score")], "manifest": []}
    if order not in orders:
        raise UnknownName(f"order {order!r}: one of {sorted(orders)}")
    paths = F.col("document.outputs").getItem("separate")
    fits = (F.size("document.clips") > 0) & (F.size(paths) == F.size("document.clips"))
    zipped = F.when(F.coalesce(fits, F.lit(False)), F.arrays_zip(F.col("document.clips").alias("c"), paths.alias("p"))).otherwise(
        F.raise_error(F.lit("clips and separate outputs of a manifest do not match")).cast("void"))
    d = documents.select(key, F.posexplode(zipped).alias("pos", "z")).where("z.c is not null")
    d = d.select(key, "pos", F.col("z.p").alias("path"), F.coalesce(_whole(F.col("z.c.final_score")), F.lit(0)).alias("final_score"),
                 F.coalesce(parse_lenient(F.col("z.c.start")), F.lit(0)).alias("start_us"))
    d = d.where(F.col("final_score") >= min_score)
    at = F.row_number().over(Window.partitionBy(key).orderBy(*orders[order], "pos"))
    return d.select(key, at.alias("at"), "path")


def order_log(clips: DataFrame) -> DataFrame:
    """video_id and the text that lists a merged reel's clips in order (at)."""
    line = F.format_string("%03d %s-%s score=%d %s", F.col("at"), to_clock(F.col("start_us") / 1e6), to_clock(F.col("end_us") / 1e6), F.col("final_score"), F.col("clip_id"))
    items = F.array_sort(F.collect_list(F.struct("at", line.alias("line"))))
    return clips.groupBy("video_id").agg(items.alias("i")).select("video_id", F.array_join("i.line", "\n").alias("log"))


class Sink(Protocol):
    """Takes ranked clips and returns what it wrote: rows of (video_id, place, path), or nothing."""

    def __call__(self, ranked: DataFrame) -> DataFrame | None: ...


def output_modes(modes: Column, every: list[str]) -> Column:
    """An array of modes with `all` spelt out, each once, in order of first mention."""
    return F.array_distinct(F.flatten(F.transform(modes, lambda m: F.when(m == "all", F.array(*map(F.lit, every))).otherwise(F.array(m)))))


def inside(root: str, name: Column) -> Column:
    """root/name; raises for a name that leads out of root."""
    bad = name.contains("/") | name.contains("\\") | name.isin("", ".", "..")
    return F.when(~bad, F.concat(F.lit(root.rstrip("/") + "/"), name)).otherwise(F.raise_error(F.concat(F.lit("a file name that leads elsewhere: "), name)).cast("string"))


def dispatch(ranked: DataFrame, modes: list[str], sinks: dict[str, Sink], manifest=None) -> list[str]:
    """Hands ranked clips to the sinks of the modes (`all`: every sink), each named once, in order.
    manifest(ranked, written by mode) comes last, clips or not."""
    wanted: list[str] = []
    for mode in modes:
        for name in sinks if mode == "all" else [mode]:
            if name not in sinks:
                raise UnknownName(f"output {name!r}: one of {sorted(sinks)}")
            if name not in wanted:
                wanted.append(name)
    with scratch(ranked.sparkSession):
        kept = cut(ranked, "ranked")  # all sinks write the same rows
        written = {name: sinks[name](kept) for name in wanted}
        if manifest is not None:
            manifest(kept, written)
    return wanted
