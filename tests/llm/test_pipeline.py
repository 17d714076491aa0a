import hashlib
import os
import random
from collections import Counter

import duckdb
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import test_lines, test_quality, test_simhash
from tests.llm.helpers import DOCS, collect, docs
from timeloom.llm import bpe, mixing
from timeloom.llm.common import cut, scratch


def texts():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(2, 8))) for _ in range(500)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(4, 9)))
    shared = "\n".join(line() for _ in range(16))
    out = [None, "", "short one"]
    for i in range(24):
        t = "\n".join(line() for _ in range(r.randint(10, 25)))
        out.append(t)
        if i % 5 == 0:
            out.append(t)
        if i % 5 == 1:
            out.append(t.replace(" ", "  ", 3))
        if i % 4 == 0:
            out.append(line() + "\n" + shared + "\n" + line() + "\n" + "\n".join(line() for _ in range(12)))
    return out


def plain(rows):
    """rows: doc_id, text, source. Counter of (doc_id, n_tokens, ids, decoded) that the pipeline gives."""
    rows = [r for r in rows if not test_quality.plain(r[1])[1]]
    rows = [(i, t, s) for (i, _, s), (_, t) in zip(rows, test_lines.plain([r[1] for r in rows]))]
    fps = [test_simhash.plain_fingerprint(t) for _, t, _ in rows]
    component = test_simhash.plain_components([r[0] for r in rows], fps)
    kept = [r for r, c in zip(rows, component) if r[0] == c]
    assert 0 < len(kept) < len(rows)
    db = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in kept], pa.int64()), "text": [r[1] for r in kept], "source": [r[2] for r in kept]})  # noqa: F841
    copies = dict(db.execute(f"SELECT doc_id, taken // size FROM ({mixing.OP4_SQL}) WHERE taken > 0").fetchall())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.multilingual().ranks, special_tokens={})
    out = Counter()
    for i, t, _ in kept:
        ids = library.encode_ordinary(t)
        row = (i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        out[row] += int(copies.get(i, 0))
    return +out


def test_run_matches_brute_force(spark, tmp_path):
    d = docs(spark, texts())
    d.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain([(r["doc_id"], r["text"], r["source"]) for r in sorted(collect(d), key=lambda r: r["doc_id"])])
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collect(P.run(spark, str(tmp_path))))
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    assert [len(s) for s in P.STAGES] == [2] * 5
    empty = spark.createDataFrame([], DOCS).withColumn("kept", F.lit("x"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and collect(out) == [], name
    assert collect(P.STAGES[-1][1](spark, empty, "")) == []


def test_rows_come_in_training_order(spark):
    r = random.Random(2)
    d = docs(spark, [" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(r.randint(1, 60))) for _ in range(400)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several files
    try:
        mixed = P.mixture(spark, d, "")
        want = [r["doc_id"] for r in mixed.collect()]
        written = cut(mixed, "mixture")
        assert len(written.inputFiles()) > 1
        assert [r["doc_id"] for r in P.tokens(spark, written, "").collect()] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_scratch_tables_go(spark):
    with scratch(spark) as kept:
        a, b = cut(spark.range(3), "a"), cut(spark.range(4), "b")
        kept.append(b)
        gone = a.inputFiles()
    assert b.count() == 4 and not any(os.path.exists(f.removeprefix("file://")) for f in gone)
