"""Windows of fixed length that recur across a corpus, as spans to remove.

The windows of each text are held as halves of runs (see anchors.py), which settle what needs no closer look:

- a class is the halves whose windows share the owning piece and what surrounds it; alone in it, a half's
  windows are unique and leave;
- halves of a class with the same whole content are equal window by window: all but the earliest are
  removed, and the earliest alone stands for them;
- the earliest of each content, where a class holds several contents, are left to a `settle` function
  (suffixes.py sorts their windows).

Counts are map-side combined and rows are marked by joins on hashed keys, which Spark splits when a
class is crowded; no class is ever gathered. A document's own spans are the only lists built.

Ids: null counts as less than any id (those under -2^62 aside); rows without an id are documents by their
text, in the order of its hash, so that they are dealt out like others. Rows that repeat an id with the same text count as one document and
each gets its result; with other texts they are told apart by 16 bits of a text hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import cut, scratch

_LEAST_ID = -(1 << 63)
#: Tokens worked on at once.
CHUNK = 1 << 20


class Bytes:
    """A text as UTF-8 bytes; windows are byte strings."""

    def __init__(self, text: bytes):
        self.text, self.size = text, len(text)

    def codes(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.text, np.uint8, hi - lo, lo).astype(np.uint64) + np.uint64(1)

    def content(self, lo: int, hi: int) -> bytes:
        return self.text[lo:hi]

    def kept(self, keep: np.ndarray) -> bytes:
        return np.frombuffer(self.text, np.uint8)[keep].tobytes()


# A place packs, from the top: the anchor's token (33 bits), the first and the last window's distance
# before it (7 bits each) and 16 bits of the text's hash. Its order is the order in the document.
def pack(at, first, last, tag):
    return (at << 30) | (first << 23) | (last << 16) | tag


def unpack(place):
    return place >> 30, (place >> 23) & 127, (place >> 16) & 127, place & 0xFFFF


def text_tag(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) & 0xFFFF


def record(names, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _halves(codes: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """The runs of anchors.runs, cut where their owner passes the middle of a window: all windows of a
    half share more than its gram (62 bytes of 100, for a gram of 24), and the hash is of what they share."""
    middle = (length - gram + 1) // 2
    which, lo, hi, at, _ = anchors.runs(codes, ends, length, gram)
    late, early = np.flatnonzero(at - lo >= middle), np.flatnonzero(at - hi < middle)
    both = np.concatenate((late, early))
    lo, hi = np.concatenate((lo[late], np.maximum(lo, at - middle + 1)[early])), np.concatenate((np.minimum(hi, at - middle)[late], hi[early]))
    hashes = anchors.rolling_hashes(codes, gram + middle)[np.concatenate((at[late] - middle, at[early]))]
    hashes[len(late) :] ^= np.uint64(0x5BD1E995)  # the two sides are classes of their own
    return which[both], lo, hi, at[both], hashes


def _runs(docs: DataFrame, kind, length: int, gram: int) -> DataFrame:
    """docs (id, text) to one row a half of a run: class (hash of what its windows share), whole (hash of
    the half's content), id, place."""
    names = ["class", "whole", "id", "place"]

    def flush(parts):
        codes = np.concatenate([p[0] for p in parts])
        ends = np.cumsum([len(p[0]) for p in parts])
        which, lo, hi, at, hashes = _halves(codes, ends, length, gram)
        base = np.concatenate(([0], ends[:-1]))
        off = np.array([p[3] for p in parts])[which] - base[which]
        a, b = at - lo, at - hi
        tags = np.array([p[4] for p in parts], np.int64)[which]
        texts = [p[2] for p in parts]
        whole = np.fromiter(
            (xxhash.xxh3_64_intdigest(texts[w].content(x, y), s) for w, x, y, s in
             zip(which.tolist(), (lo + off).tolist(), (hi + off + length).tolist(), (a * 128 + b).tolist(), strict=True)),
            np.uint64, len(lo))
        ids = np.array([p[1] for p in parts], np.int64)[which]
        return record(names, pa.array(hashes.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids),
                       pa.array(pack(at + off, a, b, tags)))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                doc, tag = kind(text), text_tag(text)
                for lo in range(0, max(doc.size - length + 1, 0), CHUNK):
                    hi = min(doc.size, lo + CHUNK + length - 1)
                    parts.append((doc.codes(lo, hi), i.as_py(), doc, lo, tag))
                    held += hi - lo
                    if held >= CHUNK:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    return docs.mapInArrow(run, "class long, whole long, id long, place long")


def _judge(rows: DataFrame) -> DataFrame:
    """Marks each row of a pass: `gone` (its windows start earlier elsewhere) or `open` (it is the
    earliest of its content, in a class of several contents). Rows that are neither drop out.

    rows is read twice, so it should be a table. The classes of several contents are a table of their
    own: a join of two plain exchanges is one that Spark can split where a class has many contents."""
    mixed = rows.groupBy("class").agg(F.min("whole").alias("least"), F.max("whole").alias("most")).where("least <> most")
    mixed = cut(mixed.select("class", F.lit(True).alias("mixed")), "mixed")
    found = rows.groupBy("class", "whole").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"))
    found = found.join(mixed, "class", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    found = found.where("n > 1 or mixed").select("class", "whole", "first", "mixed")
    own = F.struct("id", "place")
    marked = rows.join(found, ["class", "whole"])
    marked = marked.withColumn("gone", own > F.col("first"))
    return marked.withColumn("open", ~F.col("gone") & F.col("mixed")).where("gone or open").drop("first", "mixed", "whole")


def repeated_places(docs: DataFrame, kind, length: int, gram: int, settle) -> DataFrame:
    """docs (id, text). Rows (id, place) whose windows are to be removed. settle(docs, runs) gives them for
    runs (id, place) that are undecided."""
    spark = docs.sparkSession
    with scratch(spark) as kept:  # tables go as soon as the next one is written
        runs = _runs(docs, kind, length, gram)
        shared = runs.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        shared = cut(shared, "shared")  # else its sums would bind the join's exchange, which Spark then can't split
        rows = cut(runs.join(shared, "class"), "runs")
        judged = cut(_judge(rows).drop("class"), "judged")
        kept.append(judged)
    return judged.where("gone").select("id", "place").unionByName(settle(docs, judged.where("open").select("id", "place")))


def strip(docs: DataFrame, kind, length: int, gram: int, settle) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept (binary), one row for each row of docs (doc_id, text)."""
    if not 0 < gram <= length or length - gram > 127:
        raise ValueError("a gram must fit the window, within 127 tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.lit(_LEAST_ID) + F.shiftrightunsigned(F.xxhash64(text), 2)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("id"), "doc_id", text.alias("text"))
    gone = repeated_places(d.select("id", "text"), kind, length, gram, settle)
    gone = gone.groupBy("id").agg(F.collect_set("place").alias("places"))
    names = ["doc_id", "n_tokens", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            out = []
            for i, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text = text.as_py()
                doc = kind(text)
                change = np.zeros(doc.size + 1, np.int32)
                if places.is_valid:
                    at, first, last, tag = unpack(places.values.to_numpy())
                    mine = (tag == text_tag(text)) & (at - last + length <= doc.size)
                    np.add.at(change, (at - first)[mine], 1)
                    np.add.at(change, (at - last + length)[mine], -1)
                gone = np.cumsum(change)[: doc.size] > 0
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((i, doc.size, int(gone.sum()), spans, doc.kept(~gone)))
            for at in range(0, len(out), 500):
                cols = list(zip(*out[at : at + 500], strict=True))
                yield record(names, *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()))

    joined = d.join(gone, "id", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary")
