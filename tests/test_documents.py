import json
import struct

import pytest
from pyspark.sql import functions as F

from timeloom import schema as S
from timeloom.errors import UnknownName
from timeloom.operators import ranking
from timeloom.plans import documents
from timeloom.queries import QUERIES
from timeloom.sources import probe, replies

MEDIA = ("v", "/v.mp4", 12.0, 640, 360, 25.0, "h264", None, "mp4", 10)


def ranked(spark, rows):
    d = spark.createDataFrame([("v", f"c{i}", int(a * 1e6), int(b * 1e6), "highlight", "d", s, "r", ["t"], i) for i, (a, b, s) in enumerate(rows)],
                              "video_id string, clip_id string, start_us long, end_us long, category string, description string, score int, rationale string, tags array<string>, pos int")
    return ranking.rank(d, 0)


def media(spark, duration=100.0):
    names = ["video_id", *S.MEDIA.names]
    row = dict(zip(names, MEDIA)) | {"duration_sec": duration}
    return spark.createDataFrame([tuple(row[n] for n in names)], "video_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.MEDIA))


def test_plan_round_trip(spark, tmp_path):
    plan = documents.write_plan(ranked(spark, [(50, 60, 8), (20, 26, 6)]), media(spark), 3.0, 3.0)
    data = json.loads(plan.first()["plan"])
    assert [(c["start"], c["end"], c["duration_sec"]) for c in data["clips"]] == [("00:00:47.000", "00:01:03.000", 16.0), ("00:00:17.000", "00:00:29.000", 12.0)]
    (tmp_path / "plan.json").write_text(json.dumps(data, indent=2))
    read = documents.read_files(spark, str(tmp_path / "plan.json"))
    assert [r["clip_id"] for r in documents.read_clips(read, "path", 7).collect()] == ["c0"]
    assert documents.read_clips(read, "path").count() == 2
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        documents.read_files(spark, str(tmp_path / "bad.json")).select("document").collect()


def test_plan_is_clamped_and_empty_ones_are_not_written(spark):
    data = json.loads(documents.write_plan(ranked(spark, [(1, 11, 9)]), media(spark, 12.0), 3.0, 3.0).first()["plan"])
    assert (data["clips"][0]["start"], data["clips"][0]["end"]) == ("00:00:00.000", "00:00:12.000")
    assert documents.write_plan(ranked(spark, [(1, 11, 9)]).where("false"), media(spark)).count() == 0


VIDEO = {"path": "/v.mp4", "duration_sec": 12, "width": 640, "height": 360, "fps": 25.0, "video_codec": "h264", "audio_codec": None, "container": "mp4", "size_bytes": 10}


def read(spark, clips, **kw):
    d = spark.createDataFrame([("k", json.dumps({"video": VIDEO, "clips": clips}))], "key string, raw string")
    return documents.read_clips(documents.parse_documents(d, "raw"), "key", **kw).orderBy("pos").collect()


def test_reader_defaults(spark):
    got = read(spark, [{"start": "00:00", "end": "00:05", "vlm_score": 8.7}, {"start": "00:10", "end": "00:15", "final_score": 3, "id": "z", "tags": [None, "a"]}])
    assert [(r["clip_id"], r["score"], r["final_score"], r["category"], r["tags"]) for r in got] == [("clip_1", 8, 8, "highlight", []), ("z", 3, 3, "highlight", ["a"])]
    assert [r["clip_id"] for r in read(spark, [{"start": "x", "end": "y", "final_score": 1}, {"start": "00:10", "end": "00:15", "final_score": 9}], min_score=5)] == ["clip_1"]
    for bad in ({"start": "00:05", "end": "00:05"}, {"end": "00:05"}, {"start": "00:01", "end": "00:02", "category": "nope"}):
        with pytest.raises(Exception, match="invalid clip"):
            read(spark, [bad])


def judged(spark, *plans, **kw):
    d = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(plans)], "key int, raw string")
    return sorted(documents.judged_plans(documents.parse_documents(d, "raw"), "key", **kw).collect())


def test_times_may_be_seconds_and_entries_anything(spark):
    got = judged(spark, {"video": VIDEO, "clips": [7, None, "x", {"start": 1.5, "end": "00:03"}, [1], {"start": 0, "end": 4, "id": 5, "tags": "one", "vlm_score": True}]})[0]
    assert got["problem"] is None and [(c["clip_id"], c["start_us"], c["end_us"], c["score"], c["tags"]) for c in got["clips"]] == [("clip_1", 1_500_000, 3_000_000, 0, []), ("5", 0, 4_000_000, 1, ["one"])]
    many = judged(spark, {"video": VIDEO, "clips": [{"start": 0, "end": 1, "tags": [1, None, "b", True, "d", "e", "f"], "description": "", "rationale": None, "heuristic_score": 7.9, "vlm_score": 6}]})[0]["clips"][0]
    assert (many["tags"], many["description"], many["rationale"], many["heuristic_score"], many["final_score"]) == (["1", "b", "true", "d", "e"], "clip", "from plan.json", 7, 8)


def test_documents_that_are_no_plans(spark):
    clip = {"start": 0, "end": 1, "final_score": 9}
    plan = lambda **c: {"video": VIDEO, "clips": [clip, clip | c]}
    video = lambda **v: {"video": VIDEO | v, "clips": []}
    cases = [("{", "not JSON"), ("[1]", "not an object"), ({"clips": []}, "no video"), ({"video": 3, "clips": []}, "no video"), ({"video": VIDEO}, "no clips"), ({"video": VIDEO, "clips": {}}, "no clips"),
             (video(width=0), "bad video: width"), (video(fps=None), "bad video: fps"), (video(path=None), "bad video: path"), (video(size_bytes=1.5), "bad video: size_bytes"), (video(more=1), "bad video: more"),
             (video(audio_codec=3), "bad video: audio_codec"), (video(duration_sec="12.5"), None), (video(), None),
             (plan(id="i" * 90), "bad clip: id"), (plan(description="d" * 600), "bad clip: description"), (plan(rationale="r" * 301), "bad clip: rationale"), (plan(description=7), "bad clip: description"),
             (plan(category=None), "bad clip: category"), (plan(category="opera"), "bad clip: category"), (plan(start=-1), "bad clip: times"), (plan(end=None), "bad clip: times"), (plan(vlm_score=11), "bad clip: score"),
             (plan(tags=4), "bad clip: tags"), (plan(tags={"a": 1}), "bad clip: tags"), (plan(final_score=3, start="never"), None)]
    got = judged(spark, *(p for p, _ in cases), min_score=5)
    assert [r["problem"] for r in got] == [why for _, why in cases]
    assert all(bool(r["clips"]) == (r["problem"] is None and r["key"] == len(cases) - 1) for r in got)
    d = documents.parse_documents(spark.createDataFrame([(1, "[1]"), (2, json.dumps({"video": VIDEO, "clips": [clip]}))], "key int, raw string"), "raw")
    with pytest.raises(Exception, match="invalid plan: not an object"):
        documents.read_clips(d, "key").collect()
    assert [r["key"] for r in documents.read_clips(d, "key", strict=False).collect()] == [2]


def test_manifest(spark):
    r = ranked(spark, [(50, 60, 8), (20, 26, 6), (5, 15, 7)])
    out = r.select("video_id", F.lit("separate").alias("mode"), F.col("rank").alias("place"), F.concat(F.lit("p"), "pos").alias("path"))
    d = documents.parse_documents(documents.write_manifest(r, media(spark), out), "manifest")
    pick = lambda order, least=0: [x["path"] for x in documents.select_outputs(d, "video_id", least, order).orderBy("at").collect()]
    assert pick("manifest") == pick("score-desc") == ["p0", "p2", "p1"]
    assert pick("chronological") == ["p2", "p1", "p0"] and pick("chronological", 7) == ["p2", "p0"]
    with pytest.raises(UnknownName):
        documents.select_outputs(d, "video_id", 0, "random")
    short = documents.parse_documents(documents.write_manifest(r, media(spark), out.where("place > 1")), "manifest")
    with pytest.raises(Exception, match="do not match"):
        documents.select_outputs(short, "video_id", 0, "manifest").collect()
    empty = json.loads(documents.write_manifest(r.where("false"), media(spark), out.where("false")).first()["manifest"])
    assert empty["clips"] == [] and empty["outputs"] == {}


def test_dispatch(spark):
    seen = []
    sinks = {"separate": lambda df: seen.append(("separate", df.count())), "merged": lambda df: seen.append(("merged", df.count()))}
    assert documents.dispatch(ranked(spark, [(1, 9, 8)]), ["merged", "all"], sinks) == ["merged", "separate"]
    assert seen == [("merged", 1), ("separate", 1)]
    with pytest.raises(UnknownName):
        documents.dispatch(ranked(spark, []), ["tape"], sinks)
    log = documents.order_log(ranking.reel_order(ranked(spark, [(1, 9, 8)]), "chronological")).first()["log"]
    assert log == "001 00:00:01.000-00:00:09.000 score=8 c0"


def test_replies(spark):
    clip = {"id": "a", "start": "00:00:01", "end": 5, "category": "highlight", "description": "d", "score": 7, "rationale": "r", "tags": None}
    bad = [clip | {"end": "00:00:00"}, {k: v for k, v in clip.items() if k != "score"}, clip | {"score": "x"}, clip | {"score": 11}]
    body = json.dumps({"video_id": "v", "clips": [clip, *bad, clip | {"tags": "one"}], "usage": {"cost": 0.5}})
    raw = [("clean", body), ("fenced", f"```json\n{body}\n```"), ("prose", f"Here you go: {body} Bye"), ("broken", "{nope"), ("list", "[1]"), ("empty", "")]
    got = {r["id"]: r for r in replies.parse_plans(spark.createDataFrame(raw, "id string, raw string")).collect()}
    for k in ("clean", "fenced", "prose"):
        assert got[k]["problem"] is None and got[k]["dropped"] == 4 and got[k]["usd"] == 0.5
        assert [c["tags"] for c in got[k]["clips"]] == [[], ["one"]] and got[k]["clips"][0]["end_us"] == 5_000_000
    assert [got[k]["problem"] for k in ("broken", "list", "empty")] == ["not JSON", "not an object", "not JSON"]
    stamped = spark.range(1).select(replies.stamped(F.create_map(F.lit("vlm_model"), F.lit("liar"), F.lit("x"), F.lit("1")), "p", "m", F.lit(1.234), F.lit(None).cast("double")).alias("m")).first()["m"]
    assert stamped == {"x": "1", "vlm_provider": "p", "vlm_model": "m", "prompt_version": "v12", "analysis_time_sec": "1.23"}


def test_detection(spark):
    raw = ['{"content_hint": "Talk", "confidence": 0.5, "reasoning": "r"}', '{"category": " TALK ", "confidence": "90%"}', '{"label": "auto", "confidence": 1}',
           '{"type": "hybrid", "confidence": 90}', '{"type": "hybrid", "confidence": "high"}', "nothing"]
    got = replies.parse_detection(spark.createDataFrame(list(enumerate(raw)), "i int, raw string")).orderBy("i").collect()
    assert [(r["content_hint"], r["confidence"], r["problem"]) for r in got] == [
        ("talk", 0.5, None), ("talk", 0.9, None), ("auto", 1.0, "unknown hint"), ("hybrid", 90.0, "bad confidence"), ("hybrid", None, "bad confidence"), (None, None, "not JSON")]


def test_probe(spark):
    video = {"codec_type": "video", "codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "30000/1001", "r_frame_rate": "25/1", "duration": "7.5"}
    form = {"duration": "8.5", "size": "99", "format_name": "mov,mp4"}
    make = lambda f, *s: json.dumps({"format": f, "streams": s})
    rows = [("a.MKV", make(form, video, {"codec_type": "audio", "codec_name": "aac"})), ("b.MKV", make({}, video | {"avg_frame_rate": "0/0"})), ("c", make(form)),
            ("d", "junk"), ("e", make({"duration": "0"}, video | {"duration": None}))]
    got = {r["path"][0]: r for r in probe.parse_probe(spark.createDataFrame(rows, "path string, payload string")).collect()}
    assert got["a"]["fps"] == pytest.approx(29.97, abs=0.01) and got["a"]["container"] == "mov" and got["a"]["size_bytes"] == 99 and got["a"]["audio_codec"] == "aac"
    assert (got["b"]["fps"], got["b"]["duration_sec"], got["b"]["container"], got["b"]["size_bytes"]) == (25.0, 7.5, "mkv", 0)
    assert [got[k]["problem"] for k in "abcde"] == [None, None, "no video stream", "not a probe", "no duration"]


def test_files_and_samples(spark, tmp_path):
    (tmp_path / "x.pcm").write_bytes(struct.pack("<3f", 0.5, -1.0, 2.0))
    assert probe.file_signatures(spark, str(tmp_path / "*.pcm")).first()["size_bytes"] == 12
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pcm")).select(F.lit("v").alias("video_id"), "content")
    assert [(r["i"], r["x"]) for r in probe.pcm_samples(files, "video_id", "content").collect()] == [(0, 0.5), (1, -1.0), (2, 2.0)]


def test_fields_of_clips_are_read_once(spark):
    """Functions of array elements share no subexpressions: a time that is parsed piece by piece was read from the variant at each use."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        texts = spark.createDataFrame([(1, "{}")], "id long, text string")
        for df in (replies.parse_plans(texts, "text"), documents.judged_plans(texts, "id")):
            assert 1 <= df._jdf.queryExecution().analyzed().toString().count("$.start") <= 4
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_manifests_are_read_once(spark):
    plan = QUERIES["q_manifest_select"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
