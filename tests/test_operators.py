import random

import pytest
from pyspark.sql import functions as F

from timeloom.errors import CostRefused, TimelineError, UnknownName
from timeloom.operators import catalogue, chunks, intervals, profiles, ranking, readiness, sampling, signals
from timeloom.queries import QUERIES
from timeloom.tables import cut

CLIP = "video_id string, pos int, start_us long, end_us long, score int"


def clips(spark, rows, video="v"):
    return spark.createDataFrame([(video, i, int(a * 1e6), int(b * 1e6), s) for i, (a, b, s) in enumerate(rows)], CLIP)


def ranked(spark, rows, **kw):
    return [(r["start_us"] // 10**6, r["final_score"]) for r in ranking.rank(clips(spark, rows), **kw).orderBy("rank").collect()]


def test_ranking(spark):
    assert [s for s, _ in ranked(spark, [(100, 115, 10), (10, 25, 10), (50, 65, 6)])] == [10, 100, 50]
    assert ranked(spark, [(0, 1, 0), (30, 45, 9)], min_score=5) == [(30, 9)]
    assert [s for s, _ in ranked(spark, [(326, 342, 9), (333, 349, 8), (620, 630, 8)])] == [326, 620]
    assert len(ranked(spark, [(620, 632, 8), (630, 642, 8)])) == 2
    assert len(ranked(spark, [(i * 20, i * 20 + 10, 9) for i in range(5)], max_clips=2)) == 2


def plain_nms(rows, threshold):
    kept = []
    for i, (a, b, s) in sorted(enumerate(rows), key=lambda r: (-r[1][2], r[1][0], r[0])):
        iou = lambda c, d: max(0, min(b, d) - max(a, c)) / (max(b, d) - min(a, c))  # noqa: B023, E731
        if all(iou(c, d) < threshold for c, d in kept):
            kept.append((a, b))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_suppression_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(a, a + r.randint(1, 30), r.randint(0, 10)) for a in (r.randint(0, 300) for _ in range(80))]
    order = [-F.col("score"), F.col("start_us"), F.col("pos")]
    once = intervals.suppress_iou(clips(spark, rows), "video_id", "start_us", "end_us", order)
    got = sorted((x["start_us"] // 10**6, x["end_us"] // 10**6) for x in once.collect())
    assert got == plain_nms(rows, 0.5)
    again = intervals.suppress_iou(once, "video_id", "start_us", "end_us", order)
    assert again.count() == len(got)
    pairs = intervals.overlap_pairs(once, "video_id", "pos", "start_us", "end_us", 7_000_000)
    assert pairs.where("iou >= 0.5").count() == 0


def test_pairs_do_not_depend_on_the_bucket(spark):
    rows = [(0, 10, 1), (5, 30, 1), (29, 40, 1), (40, 41, 1), (2, 3, 1)]
    got = [sorted(map(tuple, intervals.overlap_pairs(clips(spark, rows), "video_id", "pos", "start_us", "end_us", b).select("a_id", "b_id").collect())) for b in (1_000_000, 10**9)]
    assert got[0] == got[1] == [(0, 1), (0, 4), (1, 2)]


def test_thinning_looks_at_the_last_kept(spark):
    d = spark.createDataFrame([("v", t / 10, None) for t in (0, 2, 4, 5, 10, 12, 13)], "video_id string, t double, scene_index int")
    assert [r["t"] for r in sampling.deduped(d).orderBy("t").collect()] == [0.0, 0.4, 1.0, 1.3]


def test_chunks(spark):
    media = spark.createDataFrame([("a", 200.0), ("b", 60.0), ("c", 61.0)], "video_id string, duration_sec double")
    got = lambda o: [(r[2], r[3]) for r in chunks.split(media, 60.0, o).where("video_id = 'a'").orderBy("chunk_index").collect()]
    assert got(0.0) == [(0, 60), (60, 120), (120, 180), (180, 200)]
    assert got(10.0) == [(0, 70), (60, 130), (120, 190), (180, 200)]
    assert chunks.split(media, 60.0).where("video_id = 'b'").count() == 0
    starts = chunks.batches(spark.createDataFrame([("v", 700.0)], media.schema), False, 20.0).orderBy("chunk_index").collect()
    assert [r["start_sec"] for r in starts] == [0, 300, 600]
    assert chunks.batches(media, False, 20.0).count() == 3
    for bad in ((20.0, 0.0), (60.0, 60.0), (60.0, -1.0)):
        with pytest.raises(TimelineError):
            chunks.split(media, *bad)


def test_merging(spark):
    c = spark.createDataFrame([("v", 0, 0, "x", 5_000_000, 15_000_000, 5), ("v", 1, 0, "x", 5_000_000, 15_000_000, 9)],
                              "video_id string, chunk_index int, pos int, clip_id string, start_us long, end_us long, score int")
    frame = lambda s: spark.createDataFrame([("v", 0, 0.0), ("v", 1, s)], "video_id string, chunk_index int, start_sec double")
    apart = chunks.merge_clips(chunks.rebase(c, frame(60.0))).orderBy("place").collect()
    assert [(r["start_us"], r["clip_id"]) for r in apart] == [(5_000_000, "c0_x"), (65_000_000, "c1_x")]
    same = chunks.merge_clips(chunks.rebase(c, frame(0.0))).collect()
    assert [r["score"] for r in same] == [9]
    meta = "video_id string, chunk_index int, provider string, model string, prompt_version string, analysis_time_sec double, cost_usd double"
    rows = [("v", i, "p", f"m{i}", "v", 1.0, 0.02) for i in (2, 0, 1)] + [("w", 0, "p", "m", "v", 1.0, None), ("w", 1, "p", "m", "v", 1.0, 1.0)]
    got = {r["video_id"]: r for r in chunks.merge_metadata(spark.createDataFrame(rows, meta)).collect()}
    assert got["v"]["cost_usd"] == pytest.approx(0.06) and got["v"]["model"] == "m0" and got["w"]["cost_usd"] is None


def test_batches_that_fail(spark):
    d = spark.createDataFrame([("v", 0, None), ("v", 1, "boom")], "video_id string, chunk_index int, error string")
    assert chunks.surviving(d).count() == 1
    with pytest.raises(Exception, match="AllBatchesFailed"):
        chunks.surviving(d.where("chunk_index = 1")).collect()
    cost = spark.createDataFrame([(0.5,), (0.7,)], "estimate_usd double")
    chunks.check_cost(cost, 1.0)
    with pytest.raises(CostRefused):
        chunks.check_cost(cost, 1.0, enabled=True)
    chunks.check_cost(cost, 1.0, enabled=True, confirm=lambda total: total < 2)


def test_candidates(spark):
    media = spark.createDataFrame([("v", 100.0)], "video_id string, duration_sec double")
    got = chunks.candidates(clips(spark, [(5, 15, 6), (90, 98, 9), (50, 60, 4)]), media).orderBy("place").collect()
    assert [(r["lo_sec"], r["hi_sec"]) for r in got] == [(70, 100), (0, 35)]


SCENE = "video_id string, scene_index int, start_sec double, end_sec double"


def test_sampling(spark):
    scene = lambda *rows: spark.createDataFrame([("v", i, float(a), float(b)) for i, (a, b) in enumerate(rows)], SCENE)
    media = lambda d: spark.createDataFrame([("v", float(d))], "video_id string, duration_sec double")
    times = lambda df: [round(r["t"], 6) for r in df.orderBy("t").collect()]
    assert times(sampling.per_scene(scene((0, 9)), 2)) == [3, 6]
    assert times(sampling.per_scene(scene((0, 8)), 3)) == [2, 4, 6]
    assert times(sampling.uniform(media(10), 2.0)) == [1, 3, 5, 7, 9]
    assert times(sampling.uniform(media(4), 10.0)) == []
    short = sampling.sampled("hybrid", scene((0, 41)), media(41)).collect()
    assert 25 <= len(short) <= 28 and all(r["scene_index"] is None for r in short)
    assert len(times(sampling.sampled("uniform", scene(), media(5), min_frames=4, interval=10.0))) >= 4
    long = times(sampling.sampled("hybrid", scene((0, 2), (2, 130)), media(130)))
    assert all(b - a >= 0.25 for a, b in zip(long, long[1:])) and len(long) == 44
    assert times(sampling.hybrid(scene(), media(9))) == [1.5, 4.5, 7.5]
    with pytest.raises(UnknownName):
        sampling.sampled("motion", scene(), media(5))


def test_stratified(spark):
    media = spark.createDataFrame([("v", 60.0)], "video_id string, duration_sec double")
    got = [[r["t"] for r in sampling.stratified(media, 9, F.lit(s)).orderBy("stratum").collect()] for s in (1, 1, 2)]
    assert got[0] == got[1] != got[2]
    assert all(i * 60 / 9 <= t < (i + 1) * 60 / 9 for i, t in enumerate(got[0]))


def test_sheets(spark):
    w = spark.createDataFrame([("v", 10.0, 12.2)], "video_id string, start_sec double, end_sec double")
    cells = sampling.sheet_cells(sampling.sheet_times(w, 0.5), 2, 1)
    assert [(r["t"], r["sheet"], r["col"]) for r in cells.orderBy("cell").collect()] == [(10.0, 0, 0), (10.5, 0, 1), (11.0, 1, 0), (11.5, 1, 1)]
    assert sampling.index_map(cells).first()["index_to_sec"] == '{"0":10.0,"1":10.5,"2":11.0,"3":11.5}'
    names = sampling.frame_names(spark.createDataFrame([("v", 1.0, 3), ("v", 2.0, None)], "video_id string, t double, scene_index int"))
    assert [r["name"] for r in names.orderBy("t").collect()] == ["kf_00000_s0003.jpg", "kf_00001_su.jpg"]


def envelope(spark, values):
    return spark.createDataFrame([("v", i, float(e)) for i, e in enumerate(values)], "video_id string, frame long, e double")


def test_peaks(spark):
    env = [0.02] * 300
    env[49:51] = [0.5] * 2
    env[200:221] = [0.4] * 21
    got = signals.peaks(envelope(spark, env)).orderBy("t").collect()
    assert [r["kind"] for r in got] == ["impact", "crowd"] and 4.5 <= got[0]["t"] <= 5.5 and 19.5 <= got[1]["t"] <= 22.5 and got[0]["strength"] >= got[1]["strength"]
    assert signals.peaks(envelope(spark, [0.1] * 200)).count() == 0
    assert signals.peaks(envelope(spark, [])).count() == 0
    env = [0.02] * 200
    env[100], env[108] = 0.3, 0.6
    got = signals.peaks(envelope(spark, env)).collect()
    assert [(r["t"], r["strength"]) for r in got] == [(10.85, 1.0)]


def test_rms_and_report(spark):
    x = spark.createDataFrame([("v", i, 0.5 if i < 10 else 1.0) for i in range(25)], "video_id string, i long, x double")
    assert [(r["t"], r["e"]) for r in signals.rms_frames(x, 10, 100).orderBy("frame").collect()] == [(0.05, 0.5), (0.15, 1.0)]
    s = spark.createDataFrame([("v", 0, 0.0, 2.0), ("v", 1, 2.004, 5.0)], SCENE)
    none = signals.peaks(envelope(spark, []))
    assert signals.report(none, signals.scene_cuts(s)).first()["report"].startswith('{"peaks":[],"cuts":[2.0],"note":"')
    media = spark.createDataFrame([("v", 9.0), ("w", 4.0)], "video_id string, duration_sec double")
    assert signals.scenes_or_whole(media, s).where("video_id = 'w'").first()["end_sec"] == 4.0


def test_catalogue(spark):
    from timeloom.schema import MODEL

    price = lambda p: {"prompt": p, "completion": p}
    arch = lambda m, i: {"modality": m, "input_modalities": i}
    rows = [("av", "A", "32000", arch(None, ["audio", "video"]), price("0.000000075")), ("img", None, None, arch(None, ["image"]), price("1")),
            ("vid", None, None, arch(None, ["video"]), price("1")), ("aud", None, None, arch(None, ["Audio"]), None),
            ("old", None, "x", arch("text+audio+VIDEO->text", None), None), ("", None, None, None, None)]
    raw = spark.createDataFrame(rows, MODEL)
    got = catalogue.usable(raw).collect()
    assert [(r["id"], r["usd_in"]) for r in got] == [("av", 0.075), ("old", None)]
    asked = spark.createDataFrame([("av",), ("vid",), ("none",)], "id string")
    assert {r["id"]: r["problem"] for r in catalogue.check_models(asked, raw).collect()} == {"av": None, "vid": "lacks input: audio", "none": "unknown model"}
    assert {r["id"]: r["supported"] for r in catalogue.supports(asked, raw, "video").collect()} == {"av": True, "vid": True, "none": False}
    assert catalogue.page(asked, 2)[1] == 1


def test_profiles(spark):
    r = spark.createDataFrame([(1, "auto"), (2, "highlights"), (3, None)], "id int, hint string")
    got = {x["id"]: (x["hint"], x["min_score"]) for x in profiles.resolve(r, 5).collect()}
    assert got == {1: ("hybrid", 5), 2: ("highlights", 7), 3: ("hybrid", 5)}


POLL = "path string, t double, size_bytes long, mtime_ns long"


def polls(spark, **files):
    return spark.createDataFrame([(p, float(i), s, s) for p, sizes in files.items() for i, s in enumerate(sizes)], POLL)


CASES = {"constant": [5] * 5, "growing": [100, 500, 900, 1000, 1000, 1000], "never": [None] * 12, "empty": [0] * 12, "endless": list(range(1, 13)), "flapping": [5, None, 5, 5, 5]}
WANT = {"constant": ("ready", 2.0), "growing": ("ready", 5.0), "never": ("timeout", 10.0), "empty": ("timeout", 10.0), "endless": ("timeout", 10.0), "flapping": ("ready", 4.0)}


def test_readiness(spark):
    got = {r["path"]: (r["status"], r["at"]) for r in readiness.from_polls(polls(spark, **CASES), 2.0, 10.0).collect()}
    assert got == WANT


def test_rolls_and_orders(spark):
    c = ranking.with_scores(clips(spark, [(1, 11, 8), (50, 60, 9)]))
    got = ranking.rolled(c, 3.0, 3.0, F.lit(12_000_000)).orderBy("pos").first()
    assert (got["start_us"], got["end_us"]) == (0, 12_000_000)
    with pytest.raises(UnknownName):
        ranking.reel_order(c, "backwards")
    assert [r["pos"] for r in ranking.reel_order(c, "alternating").orderBy("at").collect()] == [1, 0]


def test_cell_times_broadcast_no_frames(spark):
    windows = spark.range(3).selectExpr("id AS video_id", "0.0D AS start_sec", "600.0D AS end_sec")
    times = sampling.sheet_cells(sampling.sheet_times(windows, 60.0), 5, 4)
    plan = sampling.cell_times(times.select("video_id", "cell"), times.where("frame_index % 2 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_suppression_deals_rows_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(intervals, "cut", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, label))
    d = "/root/testdata/sf0.001"
    assert QUERIES["q_merge_plans"](spark, d).count() > 0 and QUERIES["q_rank_topk"](spark, d).count() > 0
    assert [p.count("Exchange") for p in plans] == [1, 1]


def test_suppression_of_unknown_times(spark):
    rows = [("v", 0, 0.0, float("nan"), 5), ("v", 1, 1.0, 2.0, 9), ("w", 0, 0.0, 10.0, 5), ("w", 1, 1.0, 10.0, 9), ("w", 2, 20.0, None, 1), (None, 0, 0.0, 4.0, 1), (None, 1, 0.0, 4.0, 2)]
    d = spark.createDataFrame(rows, "video_id string, pos int, start_us double, end_us double, score int")
    got = intervals.suppress_iou(d, "video_id", "start_us", "end_us", [-F.col("score")]).collect()
    assert {(r["video_id"], r["pos"]) for r in got} == {("v", 1), ("w", 1), ("w", 2), (None, 1)}


def test_index_map_collects_numbers(spark):
    windows = spark.createDataFrame([("v", 0.0, 6.5)], "video_id string, start_sec double, end_sec double")
    made = sampling.index_map(sampling.sheet_cells(sampling.sheet_times(windows, 0.5), 5, 4, offset=1))
    assert made.first()["index_to_sec"].startswith('{"1":0.0,"2":0.5,') and made.first()["index_to_sec"].endswith('"12":5.5,"13":6.0}')
    collected = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_collect_list" in line]
    assert len(collected) == 1 and "as string" not in collected[0]
