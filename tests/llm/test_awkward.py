"""Rows that operators must take without harm: very long texts, null ids, columns named like their own."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import test_quality, test_simhash
from tests.llm.helpers import collect, corpus, docs
from timeloom.llm import bpe, katz, mixing, quality, simhash


@pytest.fixture(scope="module")
def long():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    return " ".join(r.choice(words) + r.choice(["", "", "\n"]) for _ in range(150_000))


def test_very_long_texts(spark, long):
    texts = [long, long.replace("a", "b", 3), "one two three", None]
    d = docs(spark, texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: {k: r[k] for k in names} for r in collect(quality.ledger(d))}
    assert got == {i: test_quality.plain(t)[0] for i, t in enumerate(texts, 1)}
    near = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in collect(simhash.near_duplicates(d))}
    fps = [test_simhash.plain_fingerprint(t) for t in texts]
    assert near == {i: (f, c) for i, (f, c) in enumerate(zip(fps, test_simhash.plain_components([1, 2, 3, 4], fps)), 1)}
    sizes = {r["doc_id"]: r["size"] for r in collect(mixing.positions(d))}
    assert sizes == {i: len((t or "").split()) for i, t in enumerate(texts, 1)}


def test_columns_named_like_those_inside(spark):
    d = docs(spark, corpus(20)).drop("key")
    same = d.withColumns({c: F.lit("x") for c in ("fp", "mark", "component_id", "root", "node", "key", "size", "bucket", "tie", "word", "n", "chunk", "v", "out_", "base")})
    keep = lambda rows: sorted(map(str, rows))
    assert keep(collect(simhash.near_duplicates(same))) == keep(collect(simhash.near_duplicates(d)))
    assert keep(collect(mixing.positions(same))) == keep(collect(mixing.positions(d)))
    assert mixing.mix(same).columns == same.columns and simhash.keep_one(same).columns == same.columns
    out = (F.col("doc_id") % 5 == 0).alias("out")
    plain = d.select("doc_id", out, F.coalesce("text", F.lit("")).alias("text"))
    more = same.select("doc_id", out, F.coalesce("text", F.lit("")).alias("text"), "chunk", "v", "n", "word", "base", "bucket")
    rounded = lambda rows: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in rows)
    assert rounded(collect(katz.score(more))) == rounded(collect(katz.score(plain)))


def test_null_ids_pass_through_the_tokenizer(spark):
    d = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None), (4, "d")], "doc_id long, text string")
    got = collect(bpe.digests(d, bpe.multilingual()))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (0, 3), (0, 3), (4, 1)]


def test_null_ids_in_the_mix(spark):
    d = docs(spark, corpus(15)).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    rows = collect(mixing.positions(d))
    assert len(rows) == d.count() and sum(r["doc_id"] is None for r in rows) == d.where("doc_id is null").count()
    assert rows == collect(mixing.positions(d))
