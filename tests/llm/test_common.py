"""Tables in the shared folder belong to the block that wrote them."""

import threading
from pathlib import Path

import pytest

from timeloom.llm import common, lines, quality, resample, simhash, spelling

from .helpers import corpus, docs


def folders(spark):
    top = Path(common.shared_dir(spark).removeprefix("file://")) / "timeloom"
    return {p.name for p in top.iterdir()} if top.exists() else set()


def test_blocks_of_two_threads_keep_their_own_tables(spark):
    inside, written, failures = threading.Event(), threading.Event(), []

    def first():
        with common.scratch(spark):
            common.cut(spark.range(3), "first")
            inside.set()
            written.wait(60)

    def second():
        try:
            inside.wait(60)
            with common.scratch(spark):
                table = common.cut(spark.range(5), "second")
                written.set()
                one.join()
                assert table.count() == 5
        except Exception as e:  # noqa: BLE001
            failures.append(e)
            written.set()

    one, two = threading.Thread(target=first), threading.Thread(target=second)
    one.start()
    two.start()
    two.join(120)
    assert not failures


def test_two_queries_at_once(spark):
    d, failures, results = docs(spark, corpus(30)), [], {}

    def query(name, work):
        try:
            with common.scratch(spark):
                results[name] = sorted(map(str, work(d).collect()))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    work = {"lines": lambda x: lines.removals(x), "groups": lambda x: simhash.near_duplicates(x)}
    for name, w in work.items():
        query(name, w)
    alone, results = results, {}
    threads = [threading.Thread(target=query, args=item) for item in work.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and results == alone


def test_nothing_stays_after_a_query_is_read(spark):
    before, d = folders(spark), docs(spark, corpus(20))
    target = spark.createDataFrame([("one two three",)], "text string")
    for work in (lambda: simhash.near_duplicates(d), lambda: lines.removals(d), lambda: quality.ledger(d), lambda: spelling.variants(d), lambda: resample.resampled(d, target)):
        with common.scratch(spark):
            work().collect()
        assert folders(spark) == before


def test_what_a_block_keeps_passes_to_the_block_around_it(spark):
    before = folders(spark)
    with common.scratch(spark) as outer:
        with common.scratch(spark) as inner:
            common.cut(spark.range(1), "gone")
            kept = common.cut(spark.range(2), "kept")
            inner.append(kept)
        assert kept.count() == 2
        final = common.cut(spark.range(4), "final")
        outer.append(final)
    assert len(folders(spark) - before) == 1 and final.count() == 4
    common.discard(final)
    assert folders(spark) == before


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Fake)
    Fake.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Fake)
