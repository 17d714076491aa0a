"""Substring dedup over words: windows of 13 words, hashed by Rabin-Karp, counted in Spark.

A window is gone if its word sequence also starts in a document of smaller id; the words that gone
windows cover form maximal intervals and are removed.

First come the windows that can't repeat. Each window holds six-word pieces; the one of least
Rabin-Karp hash stands for it, so that equal windows have equal pieces. Windows in a row with the same
piece are one run, a quarter as many rows as windows. A piece with one run in the whole corpus proves the
run's windows unique, and they go no further. Every other window is hashed over its 13 words and counted:
one row a window, the hash of its piece beside its own (96 bits together), least and greatest id
combined on the map side. Windows meet the hashes that several ids have by a join of two tables, which
Spark can split where a passage is very common. Nothing is gathered but a document's own positions.

Cases: a null id counts as the least; rows that repeat id and text count as one document and get the
same result each; rows with one id and different texts are documents with equal ids, which remove nothing
from each other; null texts have no words; texts under 13 words lose nothing; very long texts are hashed
a part at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import cut, load, scratch

WINDOW = 13
#: Words of the piece that stands for a window.
PIECE = 6
_LEAST_ID = -(1 << 63)
#: Shares of the windows that meet the repeated hashes one after another.
ROUNDS = 2
#: Words hashed at once.
_PART = 1 << 19


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _parts(n: int, window: int, part: int):
    """Parts of a text of n words that share no window and lack none."""
    for lo in range(0, max(n - window + 1, 0), part):
        yield lo, min(n, lo + part + window - 1)


def _runs(docs: DataFrame, window: int, piece: int) -> DataFrame:
    """docs (id, mark, text) to a row a run: class (its piece's hash), id, mark, lo (its first window), n."""
    part = _PART

    def flush(ids, marks, offs, codes):
        ends = np.cumsum([len(c) for c in codes])
        which, lo, hi, _, hashes = anchors.runs(np.concatenate(codes), ends, window, piece)
        base = np.array(offs) - np.concatenate(([0], ends[:-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(np.array(ids, np.int64)[which]), pa.array(np.array(marks, np.int64)[which]),
             pa.array((lo + base[which]).astype(np.int64)), pa.array((hi - lo + 1).astype(np.int32))],
            names=["class", "id", "mark", "lo", "n"])

    def run(batches):
        held, got = 0, ([], [], [], [])
        for batch in batches:
            for i, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                words = text.as_py().split()
                for lo, hi in _parts(len(words), window, part):
                    for column, value in zip(got, (i, mark, lo, _codes(words[lo:hi])), strict=True):
                        column.append(value)
                    held += hi - lo
                    if held >= part:
                        yield flush(*got)
                        held, got = 0, ([], [], [], [])
        if held:
            yield flush(*got)

    return docs.mapInArrow(run, "class long, id long, mark long, lo long, n int")


def _windows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The windows of the runs: h (Rabin-Karp hash of the window), g (32 bits of its piece's), id, mark, at."""
    part = _PART
    asked = runs.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "n", "class")).alias("asked"))
    joined = docs.join(asked, ["id", "mark"]).select("id", "mark", "text", "asked")

    def run(batches):
        for batch in batches:
            for i, mark, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = text.as_py().split()
                lo, n, klass = (asked.values.field(c).to_numpy() for c in range(3))
                lo, order = np.unique(lo, return_index=True)  # rows that repeat id and text ask twice
                n, klass = n[order], klass[order]
                for a, b in _parts(len(words), window, part):
                    hashes = anchors.rolling_hashes(_codes(words[a:b]), window)
                    mine = (lo >= a) & (lo < a + part)
                    sizes = n[mine]
                    if not len(sizes):
                        continue
                    at = np.repeat(lo[mine] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                    g = np.repeat(klass[mine].astype(np.int32), sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[at - a].view(np.int64)), pa.array(g), pa.array(np.full(len(at), i, np.int64)), pa.array(np.full(len(at), mark, np.int64)),
                         pa.array(at.astype(np.int32))], names=["h", "g", "id", "mark", "at"])

    return joined.mapInArrow(run, "h long, g int, id long, mark long, at int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """docs (id, mark, text). Windows (id, mark, at) that also start in a document of smaller id. Tables in
    between go as soon as the next one is written."""
    spark = docs.sparkSession
    with scratch(spark) as result:
        with scratch(spark) as kept:
            runs = cut(_runs(docs, window, piece), "runs")
            shared = cut(runs.groupBy("class").agg(F.count("*").alias("times")).where("times > 1").select("class"), "shared")
            asked = cut(runs.join(shared, "class"), "asked")
            kept.append(asked)
        with scratch(spark) as kept:
            windows = cut(_windows(docs, asked, window), "windows")
            kept.append(windows)
        counted = windows.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        repeated = cut(counted.where("first < last").select("h", "g", "first"), "repeated")
        # Hash by hash, a share of them at a time, which bounds what lies in the shuffle.
        share = lambda df, k: df.where(F.pmod("h", F.lit(ROUNDS)) == k)
        gone = [cut(share(windows, k).join(share(repeated, k), ["h", "g"]).where("id > first").select("id", "mark", "at"), "gone") for k in range(ROUNDS)]
        result += gone
    return functools.reduce(DataFrame.unionByName, gone)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, text (kept words joined by one space), one row for each of docs."""
    if not 0 < piece <= window:
        raise ValueError("a piece must fit the window")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("id"), F.xxhash64(text).alias("mark"), "doc_id", text.alias("text"))
    gone = repeated_windows(d.select("id", "mark", "text"), window, piece)
    gone = gone.groupBy("id", "mark").agg(F.collect_list("at").alias("at"))
    names = ["doc_id", "n_words", "n_removed", "n_spans", "text"]

    def run(batches):
        for batch in batches:
            out = []
            for i, text, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = text.as_py().split()
                change = np.zeros(len(words) + 1, np.int32)
                if at.is_valid:
                    starts = np.unique(at.values.to_numpy())
                    change[starts] += 1
                    change[starts + window] -= 1
                gone = np.cumsum(change)[: len(words)] > 0
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                out.append((i, len(words), int(gone.sum()), spans, b" ".join(kept).decode()))
            for k in range(0, len(out), 500):
                cols = list(zip(*out[k : k + 500], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=names)

    joined = d.join(gone, ["id", "mark"], "left").select(F.col("doc_id").cast("long"), "text", "at")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, n_spans long, text string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS win
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS f FROM wins) WHERE f < doc_id),
marked AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p FROM gone),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d),
j AS (SELECT words.doc_id, words.p, word, marked.p IS NOT NULL AS g,
             coalesce(lag(marked.p IS NOT NULL) OVER (PARTITION BY words.doc_id ORDER BY words.p), false) AS pg
      FROM words LEFT JOIN marked USING (doc_id, p)),
a AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, count(*) FILTER (g AND NOT pg) AS n_spans,
             string_agg(word, ' ' ORDER BY p) FILTER (NOT g) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
