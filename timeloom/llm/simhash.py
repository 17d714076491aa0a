"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in at most four bits differ in
at most two bits of some segment, so the balls of radius one around their values there meet: each
fingerprint is filed under the 33 values of its ball in either segment, and rows that meet under a value
are compared over all 64 bits. Long segments keep chance meetings rare: their number grows with the
square of the distinct fingerprints, over 2^32.

Copies share a fingerprint and are one node from the start. A crowded segment value is dealt into
blocks whose pairs are compared in different tasks, and a block pair returns a spanning forest of its
true links, not all pairs: the components are the same and the rows stay linear.

Cases: null and blank texts have fingerprint 0 and link like any other; repeated rows share their
component; null ids are never chosen as component_id unless a component has no other (then null);
`keep_one` tells rows of one id, or of none, apart by their text's hash; an empty table gives an empty
result; further columns are ignored by `near_duplicates` and kept by `keep_one`. Very long texts are hashed
whole, a few numbers a word at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, load
from .graph import components

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Bits of a segment; balls of radius one on both sides search it to two flipped bits.
WIDTH = 32
#: Rows of one segment value that are compared in one go.
BLOCK = 1024
_SMALL = 8


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text; 0 if it has no word."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        flat, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[s:e], SEED) for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _mark(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (hash of the whole text), fp (long: the 64 bits)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).cast(pa.binary())
                fps = np.fromiter((simhash(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "mark", "fp"])
        pa.default_memory_pool().release_unused()  # else what the largest batch took stays with the process

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(docs).alias("mark"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links within one group of distinct fingerprints."""
    links, left = [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            near = np.bitwise_count(left ^ f) <= radius
            if near.any():
                hit, left = left[near], left[~near]
                links.append((np.full(len(hit), f, np.uint64), hit))
                front.extend(hit)
    return links


def _link_groups(key: np.ndarray, fps: np.ndarray, radius: int):
    """Links among rows with equal key (sorted): neighbours at each distance for small groups, a
    spanning forest for the rest."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    small = np.repeat(sizes <= _SMALL, sizes)
    k, f = key[small], fps[small]
    for d in range(1, _SMALL):
        if len(k) <= d:
            break
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)
        if hit.any():
            yield f[:-d][hit], f[d:][hit]
    for s, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        yield from _forest(np.unique(fps[s : s + n]), radius)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fps: distinct fingerprints (fp). Edges (a, b) whose components are those of all pairs within
    radius."""
    if radius > 5:
        raise ValueError("a radius over 5 needs larger balls")  # two segments of two flipped bits each, and one
    # A row becomes 66: a small table must not end in a few tasks.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    halves = fps.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", WIDTH))).alias("seg", "v"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(WIDTH)))
    ball = halves.select("fp", "seg", "v", F.explode(flips).alias("flip"))
    rows = ball.select((F.col("seg") * F.lit(1 << WIDTH).cast("long") + F.col("v").bitwiseXOR(F.col("flip"))).alias("key"), "fp")
    full = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")  # so that Spark can split the join
    rows = rows.join(full.hint("merge"), "key")  # here and below: never by way of the driver
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    rows = rows.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(F.when((F.col("own") == 0) & (F.col("other") == 0), F.col("key").cast("long")).otherwise(cell).alias("cell"), "fp")

    def run(batches):
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = np.concatenate((held_k, batch.column(0).to_numpy()))
            f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64)))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
            held_k, held_f = k[last:], f[last:]
            yield from out(k[:last], f[:last])
        yield from out(held_k, held_f)

    def out(k, f):
        if len(k):
            for a, b in _link_groups(k, f, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _clustered(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    """doc_id, mark, fp, root (the component's least fingerprint), component_id, a row for each of docs."""
    fps = cut(fingerprints(docs, shingle), "fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = cut(nodes, "nodes")
    # A table of its own, so that Spark can split a root that many nodes share.
    least = cut(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    nodes = nodes.join(least.hint("merge"), "root").select("fp", "root", "component_id")
    return fps.join(nodes.hint("merge"), "fp").select("doc_id", "mark", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable), one row for each row of docs."""
    return _clustered(docs, radius, shingle).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with its columns: that of the least id (null after all others),
    then of the least hash of its text. Of rows that repeat its id and text one stays."""
    found = _clustered(docs, radius, shingle).where("doc_id <=> component_id")
    found = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    # All ids of a component are the same here, or all null.
    kept = found.groupBy("root").agg(F.min(F.struct("mark", "doc_id", "n")).alias("k"))
    name = "_kept_rows"
    while any(name + part in docs.columns for part in ("", "_id", "_mark")):
        name += "_"
    kept = kept.select(F.col("k.doc_id").alias(name + "_id"), F.col("k.mark").alias(name + "_mark"), F.col("k.n").alias(name))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(name + "_id")) & (_mark(docs) == F.col(name + "_mark"))
    found = docs.join(kept, same).drop(name + "_id")
    once = found.where(F.col(name) == 1).drop(name, name + "_mark")
    again = found.where(F.col(name) > 1).dropDuplicates(["doc_id", name + "_mark"]).drop(name, name + "_mark")
    return once.unionByName(again)


def op3_simhash_components(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
