"""Suffix-array dedup: a radix sort of suffixes that stops at the threshold.

Suffixes are told apart only through their first 100 bytes, by passes over digits of some 33 bytes, the most
significant first. A pass deals each suffix by the digits it has seen so far, and so splits every group of the
pass before by one more digit; a suffix alone in its group leaves. The groups of the last pass are exactly the
repeated windows: all but the earliest suffix of each start a string that starts earlier too.

A group is named by the Rabin-Karp hash of the digits it shares (64 bits in the early passes, where a clash
only keeps a suffix for longer, 128 in the last), and dealt by that name: which of two groups comes first
changes no result, so their order isn't worked out. Between passes a suffix is an id and a place; its
digits are read from the text again.

A full suffix table would hold every byte of the corpus at eight bytes or more a row. So runs of windows
first drop out where they can't repeat, and runs that are equal as a whole are sorted once, as the earliest
of them (repeats.py).

Each byte covered by a window that also starts earlier (smaller id, or earlier in the same document)
is removed. See repeats.py for null ids and repeated rows. Null texts are empty; very long texts are hashed a
part at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, repeats
from .common import cut, load, scratch

WINDOW = 100
GRAM = 24
#: Bytes compared after each pass; the last is the window.
DEPTHS = (34, 67, 100)
#: Codes of bytes for each half of a group's name.
_CODES = np.random.default_rng(100).integers(1, 1 << 63, (2, 256), np.uint64)
_NAMES = ["id", "place", "h", "g"]


def _dealt(docs: DataFrame, live: DataFrame, depth: int, window: int) -> DataFrame:
    """The suffixes of live runs (id, place) with their group at this depth: h, and g in the last pass."""
    asked = live.groupBy("id").agg(F.collect_set("place").alias("places"))
    joined = docs.join(asked, "id").select("id", "text", "places")
    names = _NAMES if depth == window else _NAMES[:3]

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for i, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text = text.as_py()
                tag = repeats.text_tag(text)
                at, first, last, own = repeats.unpack(np.sort(places.values.to_numpy()))
                mine = (own == tag) & (at - last + window <= len(text))
                lo, n = (at - first)[mine], (first - last + 1)[mine]
                starts = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(lo) else lo
                raw = np.frombuffer(text, np.uint8)
                for a in range(0, len(text) - window + 1, repeats.CHUNK):
                    here = starts[(starts >= a) & (starts < a + repeats.CHUNK)]
                    if not len(here):
                        continue
                    b = here.max() + depth
                    a = here.min()
                    name = [anchors.rolling_hashes(codes[raw[a:b]], depth)[here - a].view(np.int64) for codes in _CODES[: len(names) - 2]]
                    parts.append((np.full(len(here), i, np.int64), repeats.pack(here, 0, 0, tag), *name))
                    held += len(here)
                    if held >= 1 << 18:
                        yield batch_of(parts)
                        parts, held = [], 0
        if parts:
            yield batch_of(parts)

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def radix_sort(docs: DataFrame, runs: DataFrame, depths=DEPTHS) -> DataFrame:
    """docs (id, text), runs (id, place) of windows. The suffixes (id, place) in a group of the last pass that
    an earlier one leads. Tables in between go as soon as the next one is written."""
    live = runs
    with scratch(docs.sparkSession) as result:
        for depth in depths:
            with scratch(docs.sparkSession) as kept:
                dealt = cut(_dealt(docs, live, depth, depths[-1]), "dealt")
                name, sums = dealt.columns[2:], [F.count("*").alias("n")]
                if depth == depths[-1]:
                    sums.append(F.min(F.struct("id", "place")).alias("first"))
                groups = dealt.groupBy(name).agg(*sums)
                # a table, so that Spark can split the join where a group is crowded
                groups = cut(groups.where("n > 1").drop("n"), "groups")
                together = dealt.join(groups, name)
                if depth == depths[-1]:
                    together = together.where(F.struct("id", "place") > F.col("first"))
                live = cut(together.select("id", "place"), "live")
                kept.append(live)
        result.append(live)
    return live


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depths=DEPTHS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: removal may split a character)."""
    if depths[-1] != window or list(depths) != sorted(set(depths)):
        raise ValueError("depths must rise to the window")
    out = repeats.strip(docs, repeats.Bytes, window, gram, lambda d, runs: radix_sort(d, runs, depths))
    return out.withColumnRenamed("n_tokens", "n_bytes")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, p, md5(substr(h, 2 * p - 1, 200)) AS w FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 99)) AS p FROM d)),
firsts AS (SELECT w, min({'d': doc_id, 'p': p}) AS f FROM wins GROUP BY w HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM wins JOIN firsts USING (w) WHERE doc_id > f.d OR (doc_id = f.d AND p > f.p)),
fresh AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS n FROM gone),
runs AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM fresh),
spans AS (SELECT doc_id, min(p) AS lo, max(p) + 99 AS hi FROM runs GROUP BY doc_id, g),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
left_over AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before - 1)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
              FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
