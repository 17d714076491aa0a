"""Line dedup by content-defined chunks of lines.

The rolling hash over ROLLING lines chooses boundaries: a chunk starts where some of its bits aren't divisible by
DIVISOR at its first lines, and ends at the next place where other bits aren't at its last lines, or with the text. Both
depend on lines inside the chunk alone, so equal passages are cut alike, whatever stands around them, and a
passage of two lines can hold a chunk. Chunks have several lines and may overlap. Those with a word in them that
occur more than once in the corpus meet the earliest (smallest id, then smallest line number). A match is taken on line
by line over NEAR lines on both sides, as long as the hashes of the lines agree: these reach to a passage's ends, where
its outermost lines bound no chunk. Matches of one pair of texts that touch become one passage, whose bytes are
compared with the earlier place's; equal ones are removed, the earliest stays.

A line goes only if an equal one stays at an earlier place. A passage must hold a whole chunk to be found, so
some of the shortest stay: README has figures.

Counts are map-side combined and written as a table of the repeated hashes, so that copies meet the
earliest by a join of two plain exchanges, which Spark splits when a chunk is very common. Lines' bytes are
fetched only for passages to compare.

Cases: a null text stays null and has no lines, like the empty one; null ids count as the least id;
rows that repeat id and text keep the same lines each; passages whose hashes agree but whose bytes
differ stay; very long texts are one row, whose lines pass one by one; an empty table gives an empty result;
further columns are kept by `dedup_lines`, whatever their names, and ignored by `removals`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import rolling_hashes
from .common import cut, load, scratch

#: Lines in the rolling hash, which a chunk has at least; one line in DIVISOR bounds no chunk; lines before and after a
#: chunk that its match may go on over.
ROLLING = 2
DIVISOR = 8
NEAR = 4
_LEAST_ID = -(1 << 63)


def _bounds(hashes: np.ndarray) -> list[tuple[int, int]]:
    """First line and end of each chunk."""
    h, n = rolling_hashes(hashes, ROLLING), np.uint64(DIVISOR)
    starts = np.flatnonzero((h >> np.uint64(8)) % n)
    ends = np.append(np.flatnonzero((h >> np.uint64(36)) % n) + ROLLING, len(hashes))
    return [*zip(starts.tolist(), ends[np.searchsorted(ends, starts + ROLLING)].tolist(), strict=True)]


def chunks_of(text: bytes):
    """(first line, lines, bytes) of each chunk."""
    lines = text.split(b"\n")
    for start, end in _bounds(_hashes(lines)):
        yield start, end - start, b"\n".join(lines[start:end])


def _hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))


def _chunks(keyed: DataFrame) -> DataFrame:
    """(id, tag, text) to its chunks with a word: h1, h2, id, tag, at, n, and 32 bits of the hashes of the NEAR lines
    before and after."""
    shape = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                       ("before", pa.list_(pa.int32())), ("after", pa.list_(pa.int32()))])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape, strict=True)], schema=shape)

    def run(batches):
        for batch in batches:
            rows = []
            for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                hashes = _hashes(lines)
                short = hashes.astype(np.uint32).view(np.int32)
                for start, end in _bounds(hashes):
                    body = b"\n".join(lines[start:end])
                    if body.split(None, 1):
                        d = xxhash.xxh3_128_digest(body)
                        rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), i, tag, start, end - start,
                                     short[max(start - NEAR, 0) : start], short[end : end + NEAR]))
                    if len(rows) >= 20_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return keyed.select("id", "tag", "text").mapInArrow(run, "h1 long, h2 long, id long, tag long, at int, n int, before array<int>, after array<int>")


def _alike(a: Column, b: Column) -> Column:
    """How many elements agree before the first that doesn't."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def _passages(chunks: DataFrame) -> DataFrame:
    """Matches of chunks with the earliest, taken on over the lines around and joined: id, tag, lo, hi, first_id, first_tag,
    shift (lines from the earlier place to this one, within their texts), chunks."""
    found = chunks.groupBy("h1", "h2").agg(F.min(F.struct("id", "tag", "at")).alias("first"), F.count("*").alias("times"))
    found = cut(found.where("times > 1").select("h1", "h2", "first"), "common")
    marked = chunks.join(found, ["h1", "h2"]).withColumn("is_first", F.struct("id", "tag", "at") == F.col("first"))
    marked = cut(marked.drop("first"), "marked")
    first = marked.where("is_first").groupBy("h1", "h2").agg(*(F.first(c).alias(f"first_{c}") for c in ("id", "tag", "at", "before", "after")))
    pairs = marked.where("not is_first").join(cut(first, "firsts"), ["h1", "h2"])
    back, on = _alike(F.reverse("before"), F.reverse("first_before")), _alike(F.col("after"), F.col("first_after"))
    shift = (F.col("at") - F.col("first_at")).alias("shift")
    pairs = pairs.select("id", "tag", "first_id", "first_tag", shift, (F.col("at") - back).alias("lo"), (F.col("at") + F.col("n") + on).alias("hi"))
    return _joined(pairs, ["id", "tag", "first_id", "first_tag", "shift"], F.count("*"))


def _joined(spans: DataFrame, key: list[str], chunks: Column) -> DataFrame:
    """Spans lo to hi that touch become one, within each key; chunks is summed up."""
    by = Window.partitionBy(*key).orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("lo") <= reach, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("part", part).groupBy(*key, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), chunks.alias("chunks")).drop("part")


def _bodies(asked: DataFrame) -> DataFrame:
    """(id, tag, text, wanted: structs of lo, hi) to a row each, with the lines' bytes."""
    schema = "id long, tag long, lo int, hi int, body binary"
    types = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.binary()]
    names = ["id", "tag", "lo", "hi", "body"]

    def run(batches):
        for batch in batches:
            for i, tag, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                lines = text.as_py().split(b"\n")
                rows = [(i.as_py(), tag.as_py(), w["lo"], w["hi"], b"\n".join(lines[w["lo"] : w["hi"]])) for w in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return asked.select("id", "tag", "text", "wanted").mapInArrow(run, schema)


def _equal(keyed: DataFrame, passages: DataFrame) -> DataFrame:
    """Those passages whose bytes are those of the earlier place."""
    earlier = passages.select(F.col("first_id").alias("id"), F.col("first_tag").alias("tag"), (F.col("lo") - F.col("shift")).alias("lo"), (F.col("hi") - F.col("shift")).alias("hi"))
    wanted = passages.select("id", "tag", "lo", "hi").unionByName(earlier).groupBy("id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("wanted"))
    bodies = _bodies(keyed.select("id", "tag", "text").join(wanted.hint("merge"), ["id", "tag"]))  # never by way of the driver
    bodies = cut(bodies.groupBy("id", "tag", "lo", "hi").agg(F.first("body").alias("body")), "bodies")
    other = bodies.select(F.col("id").alias("first_id"), F.col("tag").alias("first_tag"), F.col("lo").alias("first_lo"), F.col("hi").alias("first_hi"), F.col("body").alias("first_body"))
    d = cut(passages.join(bodies, ["id", "tag", "lo", "hi"]).withColumns({"first_lo": F.col("lo") - F.col("shift"), "first_hi": F.col("hi") - F.col("shift")}), "later")
    d = d.join(other, ["first_id", "first_tag", "first_lo", "first_hi"])
    return d.where(F.col("body") == F.col("first_body")).select("id", "tag", "lo", "hi", "chunks")


def _spans(keyed: DataFrame) -> DataFrame:
    """id, tag, gone (starts and lengths to remove, in order and apart), n_chunks (chunks that matched)."""
    with scratch(keyed.sparkSession) as result:
        passages = cut(_passages(cut(_chunks(keyed), "chunks")), "passages")
        same = cut(_equal(keyed, passages), "gone")
        result.append(same)
    apart = _joined(same, ["id", "tag"], F.sum("chunks"))
    gone = F.sort_array(F.collect_list(F.struct(F.col("lo").alias("at"), (F.col("hi") - F.col("lo")).alias("n"))))
    return apart.groupBy("id", "tag").agg(gone.alias("gone"), F.sum("chunks").alias("n_chunks"))


def _with_lines(docs: DataFrame) -> DataFrame:
    """row (all of docs), lines, gone (sorted starts and lengths to remove), n_chunks, kept_lines."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(
        row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("id"),
        F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tag"))
    d = keyed.join(_spans(keyed).hint("merge"), ["id", "tag"], "left")
    d = d.select("row", "text", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                 F.coalesce("gone", F.array().cast("array<struct<at:int,n:int>>")).alias("gone"),
                 F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n")).alias("lines"))
    ends = F.transform("gone", lambda g: g["at"] + g["n"])
    gaps = F.zip_with(F.array_prepend(ends, F.lit(0)), F.array_append(F.col("gone.at"), F.size("lines")),
                      lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    d = d.withColumn("gaps", gaps)
    kept = F.flatten(F.transform("gaps", lambda g: F.slice("lines", g["lo"] + 1, F.greatest(g["hi"] - g["lo"], F.lit(0)))))
    return d.withColumn("kept_lines", kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages, all columns kept; where a text changes, so does n_chars (if there is
    such a column)."""
    d = _with_lines(docs)
    changed = F.size("gone") > 0
    text = F.when(changed, F.array_join("kept_lines", "\n")).otherwise(F.col("row.text"))
    d = d.select("row", text.alias("new_text"), changed.alias("changed"))
    out = []
    for f in docs.schema:
        own = F.col("row").getField(f.name)
        if f.name == "text":
            own = F.col("new_text")
        elif f.name == "n_chars":
            own = F.when(F.col("changed"), F.length("new_text")).otherwise(own).cast(f.dataType)
        out.append(own.alias(f.name))
    return d.select(*out)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks (that matched), text (what is left; null stays null)."""
    d = _with_lines(docs.select("doc_id", "text"))
    text = F.when(F.size("gone") > 0, F.array_join("kept_lines", "\n")).otherwise(F.col("row.text"))
    return d.select(
        "row.doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_removed"),
        F.col("n_chunks").cast("long"), text.alias("text"))


def op10_line_chunks(spark, sf_dir: str) -> DataFrame:
    out = removals(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
