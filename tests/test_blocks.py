"""Operators whose timelines are dealt over tasks: equal to plain loops, whatever the size of blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom import tables
from timeloom.operators import chains, intervals, sampling, signals


def frames(spark, **timelines):
    rows = [(v, i, e) for v, values in timelines.items() for i, e in enumerate(values)]
    return spark.createDataFrame(rows, "video_id string, frame long, e double").repartition(3)


def medians(values, window):
    w = min(window, len(values))
    pad = np.pad(values, (w // 2, w - w // 2 - 1), mode="edge") if w > 1 else np.array(values)
    return [float(np.median(pad[i : i + w])) for i in range(len(values))]


def test_rolling_median_over_blocks(spark):
    r = random.Random(4)
    values = {f"v{n}": [r.choice([r.random(), 0.5]) for _ in range(n)] for n in (1, 2, 5, 40, 333)}
    for window in (1, 2, 7, 8, 50):
        got = {}
        for x in signals.rolling_median(frames(spark, **values), window, block=30).collect():
            got.setdefault(x["video_id"], {})[x["i"]] = x["baseline"]
        assert {v: [m[i] for i in range(len(m))] for v, m in got.items()} == {v: pytest.approx(medians(e, window)) for v, e in values.items()}


def test_frames_with_holes_and_without_values(spark):
    d = spark.createDataFrame([("v", 3, 1.0), ("v", 9000, 2.0), ("v", 9001, None), ("v", 20000, float("nan")), ("v", 20001, 5.0)], "video_id string, frame long, e double")
    got = sorted((x["frame"], x["i"], x["n"], x["baseline"]) for x in signals.rolling_median(d, 3).collect())
    assert got == [(3, 0, 3, 1.0), (9000, 1, 3, 2.0), (20001, 2, 3, 5.0)]


def test_quantiles_are_exact(spark):
    r = random.Random(6)
    values = {"one": [3.0], "same": [2.0] * 50, "two": [1.0, 2.0], "wide": [r.random() ** 30 * 1e9 for _ in range(2000)], "ties": [float(r.randint(-2, 2)) for _ in range(999)]}
    d = frames(spark, **values).withColumnRenamed("e", "x")
    for x in signals.quantiles(d, {"a": 0.25, "b": 0.75, "c": 0.5}).collect():
        v = values[x["video_id"]]
        assert (x["a"], x["b"], x["c"], x["top"]) == pytest.approx((*np.quantile(v, [0.25, 0.75, 0.5]), max(v)))


def test_nearest_low_by_a_tree_of_minima(spark):
    r = random.Random(8)
    values = [r.random() for _ in range(700)]
    asked = [(i, values[i] * r.choice([0.0, 0.01, 0.2, 0.7])) for i in range(0, 700, 3)]
    res = spark.createDataFrame([("v", i, x, 700) for i, x in enumerate(values)], "video_id string, i long, x double, n long")
    d = spark.createDataFrame([("v", i, h) for i, h in asked], "video_id string, apex long, half double")
    for fan in (3, 64, 1000):
        got = {x["apex"]: (x["left"], x["right"]) for x in signals.nearest_low(d, res, fan).collect()}
        assert got == {i: (max((j for j in range(i) if values[j] <= h), default=None), min((j for j in range(i + 1, 700) if values[j] <= h), default=None)) for i, h in asked}


def test_a_day_of_frames_in_many_tasks(spark):
    """864,000 frames of one timeline: no task takes medians of more than a block and what its windows reach."""
    n = 864_000
    d = spark.range(n).select(F.lit("day").alias("video_id"), F.col("id").alias("frame"), (F.lit(0.02) + F.when(F.col("id") % 86_400 == 50, 0.5).otherwise(0.0)).alias("e"))
    largest = signals.placed(d).groupBy("video_id", F.floor(F.col("i") / signals.BLOCK)).count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] == signals.BLOCK and largest[1] == -(-n // signals.BLOCK)
    got = sorted(x["t"] for x in signals.peaks(d).collect())
    assert got == pytest.approx([8640.0 * k + 5.05 for k in range(10)])


def thinned(times, gap):
    out = []
    for t in times:
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def strongest(rows, gap):
    out = []
    for t, s in sorted(rows):
        if out and t - out[-1][0] < gap:
            if s > out[-1][1]:
                out[-1] = (t, s)
        else:
            out.append((t, s))
    return out


def test_long_stretches_by_pointers(spark):
    r = random.Random(2)
    times = {"dense": [round(r.random() * 30, 3) for _ in range(3000)], "even": [i * 0.1 for i in range(2500)], "few": [1.0, 1.2, 9.0], "same": [4.0] * 700}
    rows = [(k, t, float(r.randint(0, 5))) for k, ts in times.items() for t in ts] + [(None, float(i) / 10, 0.0) for i in range(600)]
    times[None] = [float(i) / 10 for i in range(600)]
    d = spark.createDataFrame(rows, "video_id string, t double, strength double").repartition(4)
    for gap in (0.3, 0.7):
        got = {}
        for x in chains.chain(d, "video_id", "t", [F.col("strength")], gap, short=50).collect():
            got.setdefault(x["video_id"], []).append(x["t"])
        assert {k: sorted(v) for k, v in got.items()} == {k: thinned(sorted(v), gap) for k, v in times.items()}
        for short in (50, 10_000):
            got = {}
            for x in chains.chain(d, "video_id", "t", [F.col("strength")], gap, "strength", short=short).collect():
                got.setdefault(x["video_id"], []).append((x["t"], x["strength"]))
            want = {k: strongest([(t, s) for v, t, s in rows if v == k], gap) for k in times}
            assert {k: sorted(v) for k, v in got.items()} == want


def test_a_stretch_of_many_rows_is_dealt_over_tasks(spark):
    n = 200_000
    d = spark.range(n).select(F.lit(1).alias("video_id"), (F.col("id") / 8).alias("t"))
    assert chains.chain(d, "video_id", "t", [], 1.0).count() == n // 8


def test_a_chain_writes_no_table_and_goes_on_over_batches(spark):
    times = {"a": [i * 0.1 for i in range(40)], "b": [0.0, 0.05, 0.2, 5.0, 5.1, 5.25, 9.0], None: [0.0, 0.2, 0.3]}
    rows = [(k, t, float(i % 3)) for k, ts in times.items() for i, t in enumerate(ts)]
    d = spark.createDataFrame(rows, "video_id string, t double, strength double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for strength in (None, "strength"):
            out = chains.chain(d, "video_id", "t", [F.col("strength")], 0.25, strength)
            assert not any("/timeloom/" in p for p in out.inputFiles())
            assert "Exchange" in out._jdf.queryExecution().executedPlan().toString()
            for k, ts in times.items():
                got = sorted((x["t"], x["strength"]) for x in out.collect() if x["video_id"] == k)
                assert got == strongest([(t, s) for v, t, s in rows if v == k], 0.25) if strength else [t for t, _ in got] == thinned(ts, 0.25)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_moments_of_scenes_are_shuffled_once(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 20.0), (1, 1, 20.0, 21.0), (2, 0, 0.0, 9.5)], "video_id long, scene_index int, start_sec double, end_sec double")
    d = sampling._hybrid(scenes.repartition(2, "video_id"), 2, 3.0)
    assert sorted(round(x["t"], 3) for x in d.where("video_id = 2").collect()) == [3.167, 4.75, 6.333]
    thin = sampling.deduped(d)
    assert thin._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert d.count() == 2 + 4 + 2 + 2 + 1


def suppressed(rows, clash):
    kept = []
    for row in rows:
        if not any(clash(row, k) for k in kept):
            kept.append(row)
    return kept


def test_crowded_islands_settle_in_rounds(spark, caplog):
    r = random.Random(5)
    rows, at = [], 0
    for v in ("a", "b"):
        for i in range(500):
            a = r.randint(0, 3000)
            rows.append((v, i, a, a + r.choice([5, 10, 40, 41, 300]), r.randint(0, 10) if v == "a" else i))
    d = spark.createDataFrame(rows, "video_id string, id int, start_us long, end_us long, score int").repartition(4)
    order = [-F.col("score"), F.col("start_us"), F.col("id")]
    shared = lambda x, y: max(0, min(x[3], y[3]) - max(x[2], y[2]))
    iou = lambda x, y: shared(x, y) / (max(x[3], y[3]) - min(x[2], y[2])) >= 0.5
    part = lambda x, y: shared(x, y) / min(x[3] - x[2], y[3] - y[2]) > 0.5
    for operator, clash in ((intervals.suppress_iou, iou), (intervals.suppress_contained, part)):
        want = {(x[0], x[1]) for v in "ab" for x in suppressed(sorted((x for x in rows if x[0] == v), key=lambda x: (-x[4], x[2], x[1])), clash)}
        for short in (20, 10_000):
            with caplog.at_level("INFO"):
                got = [(x["video_id"], x["id"]) for x in operator(d, "video_id", "start_us", "end_us", order, short=short).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert "suppression round 1" in caplog.text and at == 0


def test_one_chain_of_ties_is_settled_too(spark):
    """Equal scores by start: a round settles little, so the rest goes in turn."""
    rows = [("v", i, 10 * i, 10 * i + 15) for i in range(3000)]
    d = spark.createDataFrame(rows, "video_id string, id int, start_us long, end_us long")
    got = sorted(x["id"] for x in intervals.suppress_contained(d, "video_id", "start_us", "end_us", [F.col("start_us")], 0.2, short=10).collect())
    assert got == list(range(0, 3000, 2))


def test_slices_of_all_widths(spark):
    r = random.Random(9)
    rows = [(v, r.random() * 100 - 20) for v in "ab" for _ in range(300)]
    cuts = [(v, k, a, a + w) for k, (v, a, w) in enumerate((r.choice("ab"), r.random() * 80 - 10, r.choice([0.0, 1e-5, 0.3, 1.0, 4.0, 63.9, 1e6, float("inf")])) for _ in range(120))]
    d = spark.createDataFrame(rows, "video_id string, t double")
    c = spark.createDataFrame(cuts, "video_id string, cut_id int, start_sec double, end_sec double")
    got = sorted((x["video_id"], x["t"], x["cut_id"]) for x in intervals.sliced(d, c).collect())
    assert got == sorted((v, t, k) for v, t in rows for w, k, a, b in cuts if v == w and a <= t < b)
    assert intervals.sliced(d, c.limit(0)).count() == 0


def test_tables_go_with_their_block(spark):
    from pathlib import Path

    top = Path(tables.shared_dir(spark).removeprefix("file://")) / "timeloom"
    names = lambda: set(top.iterdir()) if top.exists() else set()
    before = names()
    with tables.scratch(spark):
        assert signals.peaks(frames(spark, v=[0.02] * 50 + [0.5] + [0.02] * 50)).count() == 1
        assert names() > before
    assert names() == before
