import pytest
from pyspark.sql import functions as F

from timeloom.functions import pricing, scores, text, timecode


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_timestamps(spark):
    cases = {"00:00:00": 0, "00:00:05": 5_000_000, "00:01:23.450": 83_450_000, "01:30:00.001": 5_400_001_000, "00:00:00.5": 500_000, " 1:05 ": 65_000_000,
             "1:2:3": None, "00:60:00": None, "abc": None, "": None, "00:00:00.": None, "-1": None}
    got = values(spark, [(k,) for k in cases], "t string", timecode.parse(F.col("t")))
    assert got == list(cases.values())
    assert values(spark, [("12.5",), ("0",), ("-0.001",), ("01:00",)], "t string", timecode.parse_lenient(F.col("t"))) == [12_500_000, 0, None, 60_000_000]


def test_clock_is_cut_not_rounded(spark):
    got = values(spark, [(1.005,), (-3.0,), (3661.9999,), (360_000.0,)], "s double", timecode.to_clock(F.col("s")))
    assert got == ["00:00:01.004", "00:00:00.000", "01:01:01.999", "100:00:00.000"]


def test_clocks_of_tasks_are_those_of_columns(spark):
    import numpy as np

    seconds = [0.0, -0.5, 0.0009, 1.005, 59.9999, 60.0, 3599.999, 35_999.5, 36_000.25, 359_999.999, 360_000.0, 3_600_001.5, 1e9 + 0.123]
    told = [f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}" for ms in (max(0, int(x * 1000)) for x in seconds)]
    assert values(spark, [(x,) for x in seconds], "s double", timecode.to_clock(F.col("s"))) == told == timecode.clocks(np.array(seconds)).to_pylist()
    assert timecode.clocks(np.array([])).to_pylist() == [] and values(spark, [(None,)], "s double", timecode.to_clock(F.col("s"))) == ["00:00:00.000"]


def test_scores(spark):
    got = values(spark, [(x,) for x in (1.0, 2.9, 3.0, 60.0, 60.1, 120.0)], "d double", scores.heuristic_score(F.col("d")))
    assert got == [2, 2, 5, 5, 2, 2]
    pairs = [(7, 5), (8, 2), (6, 7), (10, 10), (0, 0)]
    assert values(spark, pairs, "v int, h int", scores.final_score(F.col("v"), F.col("h"))) == [7, 5, 8, 10, 0]


def test_overlap_measures(spark):
    rows = [(0, 10, 0, 10), (0, 5, 6, 9), (10, 30, 20, 40), (0, 10, 4, 6), (0, 5, 5, 9), (3, 3, 3, 3)]
    cols = [F.col(c) for c in "abcd"]
    assert values(spark, rows, "a int, b int, c int, d int", scores.temporal_iou(*cols)) == pytest.approx([1, 0, 1 / 3, 0.2, 0, 0])
    assert values(spark, rows, "a int, b int, c int, d int", scores.overlap_fraction(*cols)) == pytest.approx([1, 0, 0.5, 1, 0, 0])


def test_slugs(spark):
    rows = [("Hello World",), ("../../etc/passwd",), ("a — b → c",), ("",), (None,), ("x" * 50,), ("a---b",), ("--",), ("a" * 29 + " b",)]
    assert values(spark, rows, "t string", text.slugify(F.col("t"))) == [
        "Hello-World", "etc-passwd", "a-b-c", "clip", "clip", "x" * 30, "a-b", "clip", "a" * 29]


def test_redaction_is_idempotent(spark):
    raw = ["sk-ant-api03-" + "a" * 20, "x sk-or-v1-" + "b" * 24 + " y", "sk-" + "C" * 20, "AIza" + "k" * 35, "BEARER " + "t" * 20, "nothing here"]
    once = values(spark, [(r,) for r in raw], "t string", text.redact(F.col("t")))
    assert once == ["[REDACTED]", "x [REDACTED] y", "[REDACTED]", "[REDACTED]", "[REDACTED]", "nothing here"]
    assert values(spark, [(r,) for r in once], "t string", text.redact(F.col("t"))) == once


def test_isolating_json(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('Sure!\n{"a": {"b": 2}} done',), ("no object",), ("  ",), ('```\nx {"a": 1} y\n```',), ("} {",)]
    assert values(spark, rows, "t string", text.isolate_json(F.col("t"))) == [
        '{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', "no object", "", '{"a": 1}', "} {"]


def test_prices(spark):
    assert values(spark, [("0.000000075",), ("-1",), ("x",), (None,)], "p string", pricing.per_million(F.col("p"))) == [0.075, None, None, None]
    got = values(spark, [(0, None, None), (10, 0.0, 1.0)], "n int, a double, b double", pricing.image_cost(F.col("n"), F.col("a"), F.col("b")))
    assert got == pytest.approx([round((800 * 3 + 1200 * 15) / 1e6, 4), round((11800 * 3 + 1200) / 1e6, 4)])
    assert values(spark, [(None,), (429,), (404,)], "s int", pricing.retryable(F.col("s"))) == [True, True, False]
    assert values(spark, [(1.0, 2.0), (None, 2.0), (1.0, None)], "a double, b double", pricing.add_known(F.col("a"), F.col("b"))) == [3.0, 2.0, None]


def test_slugs_look_no_further_than_what_they_show(spark):
    texts = ["", None, "--a--b- c", "x" * 100, "- " * 500 + "z", "a\nb\r\nc", "A1" * 14 + "-" * 9 + "zz", "A1" * 15 + "-q", "a" + "-" * 200 + "bé"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    slug = text.slugify(F.col("t"))
    assert [r[0] for r in d.select(slug).collect()] == ["clip", "clip", "a-b-c", "x" * 30, "z", "a-b-c", "A1" * 14 + "-z", "A1" * 15, "a-b"]
    assert "regexp_extract" in str(slug)
