import json
import logging

import pytest
from pyspark.sql import functions as F

from timeloom.analysis import models, runs
from timeloom.errors import TimelineError, UnknownName
from timeloom.functions import text
from timeloom.operators import catalogue, chunks, intervals, profiles, ranking, sampling, signals
from timeloom.plans import documents
from timeloom.settings import Settings, from_environment, merged
from timeloom.sources import probe, replies


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


class Script:
    """A model that plays back what it is given."""

    provider, model, sees, hears = "script", "s-1", True, True

    def __init__(self, *plays):
        self.plays, self.requests = list(plays), []

    def ask(self, request):
        self.requests.append(request)
        play = self.plays.pop(0)
        if isinstance(play, Exception):
            raise play
        return play, None


def test_retries():
    paused = []
    m = Script(models.Transient("busy"), TimeoutError(), '{"ok": 1}')
    assert models.ask_patiently(m, {"a": 1}, models.is_object, paused.append) == ('{"ok": 1}', None) and paused == [0.5, 1.0]
    m = Script("nonsense", "", "sure: {} done")
    assert models.ask_patiently(m, {}, models.is_object, paused.append)[0] == "sure: {} done"
    assert [r["unusable"] for r in m.requests] == [None, "nonsense", ""] and len(paused) == 2  # no pause before a re-ask
    with pytest.raises(models.Unusable):
        models.ask_patiently(Script("a", "b", "c", "{}"), {}, models.is_object, paused.append)
    with pytest.raises(KeyError):
        models.ask_patiently(Script(KeyError("refused"), "{}"), {}, models.is_object, paused.append)


def test_registry():
    assert models.make(" Fixed ", hears=False).hears is False
    models.register("script", Script)
    assert isinstance(models.make("script"), Script)
    models.refuse("Later", "comes later")
    for name, reason in (("later", "comes later"), ("host", "sheet"), ("x", "unknown")):
        with pytest.raises(models.UnavailableModel, match=reason):
            models.make(name)


class Moody(models.FixedModel):
    """Fails for some segments."""

    def ask(self, request):
        if request["video_id"] == 9 or (request["video_id"] == 2 and request["start_sec"] > 250):
            raise RuntimeError("no")
        return super().ask(request)


def media(spark, *pairs):
    return spark.createDataFrame(pairs, "video_id long, duration_sec double").withColumn("max_sec", F.lit(20.0))


def test_batches_fail_one_by_one(spark):
    found = runs.analyse(media(spark, (1, 100.0), (2, 900.0)), Moody(), audio=False)
    got = {r["video_id"]: r for r in rows(found.metadata)}
    assert got[1]["n_chunks"] == 1 and got[2]["n_chunks"] == 1 and got[2]["cost_usd"] == pytest.approx(0.001)
    assert {r["chunk_index"] for r in rows(found.clips.where("video_id = 2"))} == {0}
    with pytest.raises(Exception, match="AllBatchesFailed"):
        runs.analyse(media(spark, (9, 100.0)), Moody(), audio=False).clips.collect()
    with pytest.raises(Exception, match="duration_sec must be over 0"):
        runs.analyse(media(spark, (1, 0.0)), Moody(), audio=False).clips.collect()


def test_two_passes_and_costs(spark):
    found = runs.analyse(media(spark, (1, 50.0), (22, 400.0)), models.make("fixed"), audio=True, refine=True)
    got = {r["video_id"]: r for r in rows(found.metadata)}
    assert got[1]["estimate_usd"] == pytest.approx(50 * 0.0001) and got[22]["estimate_usd"] == pytest.approx(400 * 0.0001 * 2)
    forced = runs.analyse(media(spark, (1, 50.0)), models.make("fixed"), audio=True, refine=True, force=True)
    assert rows(forced.metadata)[0]["estimate_usd"] == pytest.approx(0.01)
    asked = []
    with pytest.raises(Exception, match="the cap is"):
        runs.analyse(media(spark, (1, 50.0)), models.make("fixed"), audio=True, cap=0.001, confirm=lambda usd: asked.append(usd))
    assert asked == [pytest.approx(0.005)]
    runs.analyse(media(spark, (1, 50.0)), models.make("fixed"), audio=True, cap=0.001, confirm=lambda usd: True)


def test_whole_run_by_route(spark):
    payload = json.dumps({"format": {"duration": "100"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2, "avg_frame_rate": "25/1"}]})
    asked = spark.createDataFrame([(1, "a.mp4", payload, "talk"), (2, "b.mp4", payload, "highlights")], "video_id long, path string, payload string, hint string")
    none = spark.createDataFrame([], "video_id long, scene_index int, start_sec double, end_sec double")
    for model, routes in ((models.make("fixed"), {1: "audio", 2: "video"}), (models.make("fixed", sees=False, hears=False), {1: "keyframe", 2: "keyframe"})):
        ranked, plans = runs.run(asked, none, model, default_score=0)
        got = {r["video_id"]: json.loads(r["plan"]) for r in rows(plans)}
        assert all(got[i]["sampling"]["strategy"] == routes[i].replace("keyframe", "hybrid") for i in got) and set(got) == {r["video_id"] for r in rows(ranked)}
        assert all(p["vlm"]["provider"] == "fixed" and p["video"]["width"] == 4 for p in got.values()) and 1 in got
    with pytest.raises(Exception, match="no video stream"):
        runs.run(asked.withColumn("payload", F.lit('{"streams": []}')), none, models.make("fixed"))[0].collect()
    capable = spark.createDataFrame([("m",)], "id string")
    raw = spark.createDataFrame([("m", ("audio+video->text", None))], "id string, architecture struct<modality:string,input_modalities:array<string>>")
    assert rows(runs.require_capable(capable, raw)) == [{"id": "m"}]
    with pytest.raises(Exception, match="unknown model"):
        runs.require_capable(capable, raw.where("false")).collect()
    with pytest.raises(TimelineError):
        runs.detect_hints(media(spark, (1, 5.0)), models.make("fixed"), n=2)


def test_one_dead_timeline_costs_no_other(spark):
    found = runs.analyse(media(spark, (1, 100.0), (2, 900.0), (9, 100.0), (9_000, 700.0)), Moody(), audio=False, strict=False)
    got = {r["video_id"]: (r["status"], r["n_batches"], r["n_lost"], r["reason"]) for r in rows(found.outcomes)}
    assert got == {1: ("done", 1, 0, None), 2: ("partial", 3, 2, "RuntimeError: no"), 9: ("failed", 1, 1, "RuntimeError: no"), 9_000: ("done", 3, 0, None)}
    assert {r["video_id"] for r in rows(found.clips)} == {1, 2, 9_000} == {r["video_id"] for r in rows(found.metadata)}
    twice = runs.analyse(media(spark, (1, 100.0), (2, 900.0), (9, 100.0)), Moody(), audio=False, refine=True, strict=False)
    got = {r["video_id"]: r["status"] for r in rows(twice.outcomes)}
    assert got == {1: "done", 2: "partial", 9: "failed"} and 9 not in {r["video_id"] for r in rows(twice.clips)}


def test_run_tells_of_files_that_cannot_be_used(spark):
    payload = lambda sec: json.dumps({"format": {"duration": str(sec)}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2, "avg_frame_rate": "25/1"}]})
    asked = spark.createDataFrame([(1, "a.mp4", payload(100), "talk"), (2, "b.mp4", "junk", "talk"), (3, "c.mp4", payload(3), "highlights"), (9, "d.mp4", payload(40), "hybrid")],
                                  "video_id long, path string, payload string, hint string")
    none = spark.createDataFrame([], "video_id long, scene_index int, start_sec double, end_sec double")
    r = runs.run_all(asked, none, Moody(sees=False, hears=False), default_score=0)
    got = {x["video_id"]: (x["status"], x["reason"]) for x in rows(r.outcomes)}
    assert got == {1: ("done", None), 2: ("failed", "not a probe"), 3: ("done", None), 9: ("failed", "RuntimeError: no")}
    plans = {x["video_id"]: json.loads(x["plan"]) for x in rows(r.plans)}
    # A 3 s timeline is sampled as often as its profile asks; the estimate is that of so many images.
    if 3 in plans:
        assert plans[3]["sampling"] == {"strategy": "hybrid", "n_keyframes": 9, "n_scenes": 0} and plans[3]["vlm"]["cost_upfront_estimate_usd"] == pytest.approx((800 + 9900) * 3e-6 + 0.018, abs=1e-4)
    assert plans[1]["sampling"]["n_keyframes"] == 67 and plans[1]["vlm"]["cost_estimate_usd"] == plans[1]["vlm"]["cost_upfront_estimate_usd"]


def test_frames_of_several_profiles_in_one_plan(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 200.0), (2, 0, 0.0, 130.0), (3, 0, 0.0, 5.0)], "video_id long, scene_index int, start_sec double, end_sec double")
    m = spark.createDataFrame([(1, 200.0, "hybrid", 8), (2, 130.0, "scene", 2), (3, 5.0, "uniform", 3), (4, 3.0, "hybrid", 8)], "video_id long, duration_sec double, sampling string, min_frames int")
    got = {}
    for r in rows(sampling.sampled(F.col("sampling"), s, m, F.col("min_frames"))):
        got.setdefault(r["video_id"], []).append(r["t"])
    for v, name, least in ((1, "hybrid", 8), (2, "scene", 2), (3, "uniform", 3), (4, "hybrid", 8)):
        own = m.where(F.col("video_id") == v).select("video_id", "duration_sec")
        assert sorted(got[v]) == sorted(r["t"] for r in rows(sampling.sampled(name, s.where(F.col("video_id") == v), own, least)))
    assert len(got[4]) == 9  # eight and one steps, from the middle of each
    with pytest.raises(Exception, match="unknown strategy: odd"):
        sampling.sampled(F.lit("odd"), s, m).collect()


def test_cuts_of_a_plan(spark):
    video = {"path": "/v.mp4", "duration_sec": 12, "width": 640, "height": 360, "fps": 25.0, "video_codec": "h264", "container": "mp4", "size_bytes": 10}
    plan = {"video": video, "clips": [{"start": 1, "end": 2, "final_score": 9, "description": "A b"}, {"start": 3, "end": 4, "final_score": 2}, {"start": 5, "end": 8, "final_score": 7}]}
    d = documents.parse_documents(spark.createDataFrame([(1, json.dumps(plan))], "key int, plan string"), "plan")
    got = sorted((r["place"], r["start_us"], r["end_us"], r["file"]) for r in rows(runs.cuts_from(d, "key", 5)))
    assert got == [(1, 1_000_000, 2_000_000, "s09_clip_001_A-b.mp4"), (2, 5_000_000, 8_000_000, "s07_clip_002_clip.mp4")]


def test_prober_seam(spark):
    def prober(path, timeout):
        if path == "gone":
            raise FileNotFoundError
        if path == "slow":
            raise TimeoutError
        return (1, "") if path == "bad" else (0, "{" if path == "broken" else '{"streams": []}')

    d = spark.createDataFrame([(p,) for p in ("gone", "slow", "bad", "broken", "mute")], "path string")
    got = {r["path"]: r["problem"] for r in rows(probe.probe_files(d, prober))}
    assert got == {"gone": "no such file", "slow": "no answer in 30 s", "bad": "exit code 1", "broken": "not a probe", "mute": "no video stream"}


def test_probers_that_hang_or_die(spark):
    def prober(path, timeout):
        import os
        import time

        if path == "hangs":
            time.sleep(600)
        if path == "dies":
            os._exit(3)
        if path == "raises":
            raise KeyError("x")
        return 0, '{"streams": []}'

    d = spark.createDataFrame([(p,) for p in ("hangs", "dies", "raises", "mute")], "path string").coalesce(1)
    got = {r["path"]: r["problem"] for r in rows(probe.probe_files(d, prober, timeout=0.5))}
    assert got == {"hangs": "no answer in 0.5 s", "dies": "exit code 3", "raises": "KeyError: 'x'", "mute": "no video stream"}


def test_catalogue_payloads(spark, tmp_path):
    file = tmp_path / "models.json"
    file.write_text(json.dumps({"data": [{"id": "b", "architecture": {"modality": "audio"}}, 7, "x", {"id": "b", "architecture": {"modality": "video"}}]}))
    raw = catalogue.read_catalogue(spark, str(file))
    assert [(r["position"], r["id"]) for r in rows(raw)] == [(0, "b"), (3, "b")]
    asked = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {r["id"]: r["problem"] for r in rows(catalogue.check_models(asked, raw))} == {"b": "lacks input: video", "c": "unknown model"}
    for bad, why in (("{", "not JSON"), ('{"data": 3}', "no list of data"), ("[]", "no list of data")):
        file.write_text(bad)
        with pytest.raises(Exception, match=why):
            catalogue.read_catalogue(spark, str(file)).collect()


def test_strict_rules(spark):
    one = spark.createDataFrame([(1, None)], "video_id long, duration_sec double")
    none = spark.createDataFrame([], "video_id long, scene_index int, start_sec double, end_sec double")
    with pytest.raises(Exception, match="unknown duration"):
        signals.scenes_or_whole(one, none).collect()
    clips = spark.createDataFrame([(1, 3, "c", 0, 5)], "video_id long, chunk_index int, clip_id string, start_us long, end_us long")
    with pytest.raises(Exception, match="unknown chunk"):
        chunks.rebase(clips, spark.createDataFrame([(1, 0, 0.0)], "video_id long, chunk_index int, start_sec double")).collect()
    with pytest.raises(Exception, match="unknown hint: opera"):
        spark.range(1).select(profiles.asked_for(F.lit("opera"), F.lit(None).cast("string"))).collect()
    with pytest.raises(Exception, match="leads elsewhere"):
        spark.range(1).select(documents.inside("out", F.lit("../x"))).collect()
    with pytest.raises(TimelineError) as raised:
        ranking.rolled(clips, -1, 0, F.lit(1))
    assert not isinstance(raised.value, UnknownName)
    assert rows(spark.range(1).select(profiles.with_default(F.lit(None).cast("string"), "opera").alias("h"))) == [{"h": "auto"}]
    assert "minimum" in profiles.clip_schema()


def test_sinks_then_manifest(spark):
    ranked = spark.createDataFrame([], "video_id long")
    log = []
    sinks = {"separate": lambda r: log.append("separate"), "merged": lambda r: log.append("merged")}
    documents.dispatch(ranked, ["all", "merged"], sinks, lambda r, w: log.append(sorted(w)))
    assert log == ["separate", "merged", ["merged", "separate"]]
    with pytest.raises(UnknownName):
        documents.dispatch(ranked, ["x"], sinks)


def test_plan_blocks_win(spark):
    r = spark.createDataFrame([(1, 1, "c", 1_000_000, 3_000_000, "filler", "d", "r", 5, 5, 5, ["t"])],
                              "video_id long, rank int, clip_id string, start_us long, end_us long, category string, description string, rationale string, score int, heuristic_score int, final_score int, tags array<string>")
    m = spark.createDataFrame([(1, "p", 10.0, 1, 1, 25.0, "h", "a", "mp4", 9, "x")], "video_id long, path string, duration_sec double, width int, height int, fps double, video_codec string, audio_codec string, container string, size_bytes long, own string")
    plan = json.loads(rows(documents.write_plan(r, m, 0.5, F.lit(2.0), {"note": F.col("own"), "video": F.lit("mine")}))[0]["plan"])
    assert plan["video"] == "mine" and plan["note"] == "x" and plan["clips"][0]["start"] == "00:00:00.500" and plan["clips"][0]["end"] == "00:00:05.000"


def test_samples_to_peaks(spark):
    n = 1600 * 60
    x = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("i"), F.when(F.col("id").between(1600 * 30, 1600 * 32 - 1), 1.0).otherwise(0.001 * (F.col("id") % 7)).alias("x"))
    got = rows(signals.audio_peaks(x))
    assert [r["t"] for r in got] == [3.05] and got[0]["kind"] == "impact"
    assert rows(signals.audio_peaks(x.where("false"))) == []


def test_slices_sheets_and_concat(spark):
    t = spark.createDataFrame([(1, float(i)) for i in range(6)], "video_id long, t double")
    cuts = spark.createDataFrame([(1, 1, 1.0, 3.0), (1, 2, 2.0, 2.0)], "video_id long, cut_id int, start_sec double, end_sec double")
    assert sorted((r["t"], r["since"]) for r in rows(intervals.sliced(t, cuts))) == [(1.0, 0.0), (2.0, 1.0)]
    with pytest.raises(TimelineError):
        intervals.concat_ordered()
    names = spark.createDataFrame([(1, "b"), (1, "a")], "video_id long, name string")
    assert {r["name"]: r["at"] for r in rows(sampling.sheet_order(names))} == {"a": 1, "b": 2}


def test_settings(tmp_path, caplog):
    file = tmp_path / "s.toml"
    file.write_text('min_score = 3\noutputs = ["merged"]\n[extra]\na = 1\n')
    s = Settings.load(file, {"TIMELOOM_MIN_SCORE": "6", "OTHER": "1"}, max_clips=4)
    assert (s.min_score, s.max_clips, s.outputs, s.overlap) == (6, 4, ("merged",), 0.5)
    assert "settings that don't exist: extra" in caplog.text
    assert Settings.load(tmp_path / "none.toml", {}) == Settings()
    assert from_environment({"TIMELOOM_A__B": "x", "TIMELOOM_A__C": "y"}) == {"a": {"b": "x", "c": "y"}}
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    logger = logging.getLogger("timeloom-test")
    text.redact_logs(logger)
    text.redact_logs(logger)
    assert len(logger.filters) == 1
    with caplog.at_level(logging.INFO):
        logger.info("key %s", "sk-" + "a1" * 12)
        logger.info("bad %d", "x") if False else None
    assert "[REDACTED]" in caplog.text and "a1a1" not in caplog.text


def test_plan_problem(spark):
    d = spark.createDataFrame([('{"video_id": "v", "duration_sec": 1}',), ('{"video_id": "' + "v" * 129 + '", "duration_sec": 1}',), ("[1]",)], "raw string")
    assert [r["p"] for r in rows(d.select(replies.plan_problem(F.col("raw")).alias("p")))] == [None, "bad video_id", "not an object"]


def test_replies_are_read_once(spark):
    """Clips, metadata and outcomes come from answers that were read and written once."""
    media = spark.createDataFrame([(1, 700.0, 20.0), (2, 50.0, 20.0)], "video_id long, duration_sec double, max_sec double")
    found = runs.analyse(media, models.make("fixed"), audio=False, strict=False)
    for df in (found.clips, found.metadata, found.outcomes):
        assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["video_id"], r["n_chunks"]) for r in found.metadata.collect()) == [(1, 3), (2, 1)]


def test_requests_are_probed_once(spark):
    """Each step of a run goes by one table of probed requests, and two requests for one file are two."""
    payload = json.dumps({"format": {"duration": "400"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2, "avg_frame_rate": "25/1"}]})
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    asked = spark.createDataFrame([(1, "a.mp4", payload, "hybrid"), (2, "a.mp4", payload, "talk"), (3, "b.mp4", "junk", "talk")], "video_id long, path string, payload string, hint string")
    scenes = spark.createDataFrame([(1, 0, 0.0, 400.0), (2, 0, 0.0, 400.0)], "video_id long, scene_index int, start_sec double, end_sec double")
    for model in (models.make("fixed"), models.make("fixed", sees=False, hears=False)):
        before = read.value
        r = runs.run_all(asked.mapInArrow(counted, asked.schema), scenes, model, default_score=0)
        assert sorted(x["video_id"] for x in rows(r.plans)) == [1, 2]
        assert sorted((x["video_id"], x["status"]) for x in rows(r.outcomes)) == [(1, "done"), (2, "done"), (3, "failed")]
        assert read.value - before == 3


def test_a_plan_is_written_once(spark):
    """Reading a plan's clips doesn't make its text anew for the filter on them."""
    r = spark.createDataFrame([(1, 1, "c", 1_000_000, 3_000_000, "filler", "d", "r", 5, 5, 5, ["t"])],
                              "video_id long, rank int, clip_id string, start_us long, end_us long, category string, description string, rationale string, score int, heuristic_score int, final_score int, tags array<string>")
    m = spark.createDataFrame([(1, "p", 10.0, 1, 1, 25.0, "h", "a", "mp4", 9)], "video_id long, path string, duration_sec double, width int, height int, fps double, video_codec string, audio_codec string, container string, size_bytes long")
    d = documents.parse_documents(documents.write_plan(r, m), "plan").select("video_id", F.explode("document.clips").alias("c"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1
    assert [x["c"]["id"] for x in rows(d)] == ["c"]


def test_lines_of_sampled_frames(spark):
    """Lists made by the tasks that thin are those of the steps one by one, of timelines of any length."""
    s = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 200.0), (1, 2, 199.9, 200.3), (1, 3, 7.0, 7.0), (2, 0, 0.0, 130.0), (3, 0, 0.0, 5.0), (6, 0, 100.0, 400_000.0), (7, 0, 50.0, 40.0)],
                              "video_id long, scene_index int, start_sec double, end_sec double")
    m = spark.createDataFrame([(1, 200.0, "hybrid", 8), (2, 130.0, "scene", 2), (3, 5.0, "uniform", 3), (4, 3.0, "hybrid", 8), (5, 500.0, "hybrid", 5), (6, 400_000.0, "hybrid", 5), (7, 200.0, "hybrid", 4), (8, 60.0, "scene", 3),
                               (9, 0.0, "hybrid", 3), (10, 0.5, "uniform", 8), (11, 119.9, "hybrid", 3)], "video_id long, duration_sec double, sampling string, min_frames int")
    asked = (F.col("sampling"), s, m, F.col("min_frames"))
    frames = sampling.frame_names(sampling.sampled(*asked)).select("video_id", F.col("frame").alias("frame_index"), "t")
    told = {r["video_id"]: r["lines"] for r in rows(profiles.frame_lines(frames))}
    got = rows(sampling.listed(*asked))
    assert {r["video_id"]: r["lines"] for r in got} == told and len(got) == len(told) and 9 not in told and len(told) == 10
    assert all(r["n_frames"] == len(r["lines"].split("\n")) for r in got) and "111:06:" in told[6]
    texts = [f"{x}" for x in (1, 2)]
    named = sampling.listed("uniform", s.where("false").withColumn("video_id", F.col("video_id").cast("string")), spark.createDataFrame([(x, 5.0) for x in texts], "video_id string, duration_sec double"), 1)
    assert sorted((r["video_id"], r["lines"]) for r in rows(named)) == [(x, "0: 00:00:01.000\n1: 00:00:03.000") for x in texts]
