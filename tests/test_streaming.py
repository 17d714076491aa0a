import os
import time

import pytest
from pyspark.sql import functions as F

from tests.test_operators import CASES, POLL, WANT, polls
from timeloom.plans import documents, sink
from timeloom.sources import folders
from timeloom.streaming import readiness, windows


def test_readiness_over_micro_batches(spark, tmp_path):
    every = polls(spark, **CASES)
    for i, (lo, hi) in enumerate(((0, 3), (3, 5), (5, 12))):
        every.where(f"t >= {lo} and t < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = readiness.watch(stream, 2.0, 10.0).writeStream.format("memory").queryName("ready").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        assert until(spark, "ready", len(WANT)) == WANT
    finally:
        q.stop()


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") * 7 % 60).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r["window_start"], r["n"], r["total"]) for r in windows.hopping(rows, "ts", "value", "20 seconds", "10 seconds").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.hopping(stream, "ts", "value", "20 seconds", "10 seconds", late="1 second").writeStream.format("memory").queryName("hops").outputMode(
        "complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["window_start"], r["n"], r["total"]) for r in spark.table("hops").collect()} == want
    assert windows.tumbling(rows, "ts", "value", "60 seconds").first()["n"] == 60


def until(spark, table, n, seconds=60):
    """The rows of a memory table, once there are n of them."""
    end = time.time() + seconds
    while time.time() < end and spark.table(table).count() < n:
        time.sleep(0.3)
    return {r["path"]: (r["status"], r["at"]) for r in spark.table(table).collect()}


def test_a_path_that_nobody_polls_again_runs_out_of_time(spark, tmp_path):
    spark.createDataFrame([("lost", 0.0, 5, 1), ("lost", 1.0, 6, 1), ("other", 0.0, 5, 1), ("other", 2.0, 5, 1)], POLL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POLL).parquet(str(tmp_path / "in"))
    q = readiness.watch(stream, 2.0, 4.0).writeStream.format("memory").queryName("lost").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        assert until(spark, "lost", 2) == {"lost": ("timeout", 4.0), "other": ("ready", 2.0)}
    finally:
        q.stop()


def test_late_polls_are_ignored_across_batches(spark, tmp_path):
    for i, rows in enumerate(([(0.0, 5), (3.0, 9)], [(1.0, 5), (2.0, 5)], [(4.0, 9), (5.0, 9)])):
        spark.createDataFrame([("p", t, n, n) for t, n in rows], POLL).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = readiness.watch(stream, 2.0, 100.0).writeStream.format("memory").queryName("late").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        assert until(spark, "late", 1) == {"p": ("ready", 5.0)}
    finally:
        q.stop()


def test_readiness_of_files_in_a_folder(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "whole.bin").write_bytes(b"x" * 9)
    (folder / "empty.bin").write_bytes(b"")
    stream = folders.polls(spark, str(folder), str(tmp_path / "log"), every=0.2)
    q = readiness.watch(stream, 1.5, 600.0).writeStream.format("memory").queryName("folder").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        grown = time.time() + 3
        while time.time() < grown or not spark.table("folder").count():
            with (folder / "grows.bin").open("ab") as f:
                f.write(b"y")
            assert time.time() < grown + 60
            time.sleep(0.3)
        assert {os.path.basename(p): s for p, (s, _) in until(spark, "folder", 1).items()} == {"whole.bin": "ready"}
        got = until(spark, "folder", 2)
        assert {os.path.basename(p): s for p, (s, _) in got.items()} == {"whole.bin": "ready", "grows.bin": "ready"}
    finally:
        q.stop()


def test_a_listing_is_read_again_as_it_was(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"12")
    reader = folders._Polls({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")})
    one = reader.latestOffset()
    (tmp_path / "in" / "a").write_bytes(b"1234")
    again = folders._Polls({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")})
    two = again.latestOffset()
    assert (one, two) == ({"poll": 1}, {"poll": 2})
    sizes = lambda a, b: [r[2] for p in again.partitions(a, b) for r in again.read(p)]
    assert sizes({"poll": 0}, two) == [2, 4] and sizes(one, two) == [4]
    again.commit(two)
    assert sizes(one, two) == [4] and sorted(os.listdir(tmp_path / "log")) == ["000000000002.json"]


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).repartition(4).select("id", F.concat(F.lit("é"), "id").alias("name"), F.array("id").alias("list"))
    bad = rows.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no such row")).cast("long")).otherwise(F.col("id")))
    kinds = "id long, name string, list array<long>"
    with pytest.raises(Exception, match="no such row"):
        sink.write(bad, path)
    assert not os.path.exists(f"{path}/manifest.json") and sink.read(spark, path, kinds).count() == 0
    sink.write(rows, path)
    assert sorted(r["id"] for r in sink.read(spark, path, kinds).collect()) == list(range(100))
    with pytest.raises(Exception, match="no such row"):
        sink.write(bad, path, "overwrite")
    assert sink.read(spark, path, kinds).count() == 100  # as before
    sink.write(rows.limit(3), path)
    assert sink.read(spark, path, kinds).count() == 103
    documents.dispatch(rows.where("id < 5"), ["lines"], {"lines": sink.to_folder(path)})
    assert sorted(r["name"] for r in sink.read(spark, path, kinds).collect()) == [f"é{i}" for i in range(5)]
    parts = lambda: {f for f in os.listdir(path) if f.startswith("part-")}
    orphans = len(parts()) - 4
    assert sink.vacuum(path) >= max(orphans, 0) and len(parts()) <= 4 and sink.read(spark, path, kinds).count() == 5
