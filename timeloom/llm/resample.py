"""Importance resampling towards a target distribution, over hashed runs of words.

A dictionary of the corpus' most frequent words is an Aho-Corasick automaton, whose keys are words between
two delimiters and whose payloads are the words' CRC-32 and length in bytes. One scan of a text gives the
payloads of its words in order; words outside the dictionary lie in the gaps between matches and get
theirs from their bytes, so the dictionary's size changes no result. The CRC-32 of a run of words follows from
the payloads of its parts: appending n bytes is a linear map of the CRC before them. A feature's bucket is
its CRC modulo the number of buckets.

The scan writes a histogram of buckets a text. Counting sums the histograms of all documents and of all
target texts by bucket; scoring weighs a document's own histogram with the gain of each bucket, and adds
Gumbel noise drawn from its id, so that the highest scores are a weighted sample without replacement.

What is sent to tasks is bounded: DICTIONARY words of WORD_CHARS, and one gain a bucket. Ranks come from a
range-partitioned sort: a row's place in its file, plus the drawable rows in the files before.

Cases: a null or empty text has no features, weight 0, and can't be drawn; null ids count as the empty text
in the noise and come last among equal scores; rows that repeat an id have the same noise, and both rank;
very long texts are one row, scanned as a whole (some 20 bytes of memory a character); without any target
text every gain is that of t = 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, load, scratch

#: Words in the dictionary at most, and characters in each.
DICTIONARY, WORD_CHARS = 50_000, 40
BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
#: Characters that are scanned together, where texts are shorter.
_SLICE = 1_000_000
#: Bytes: A-Z to a-z, other letters, digits and bytes of 128 or more stay, all else becomes a blank.
_FLAT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def flat(text: str | None) -> str:
    return (text or "").encode().translate(_FLAT).decode()


def _shift_tables() -> list[np.ndarray]:
    """For each k the map of a CRC over 2^k zero bytes, as four tables of 256 by byte of the CRC."""
    def linear(columns):
        return np.array([[np.bitwise_xor.reduce([columns[8 * b + j] for j in range(8) if v >> j & 1] or [0]) for v in range(256)] for b in range(4)], np.uint32)

    def apply(table, c):
        return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]

    one = []
    for j in range(32):
        c = 1 << j
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one.append(c)
    tables = [linear(one)]
    while len(tables) < 40:
        t = tables[-1]
        tables.append(linear([int(apply(t, apply(t, np.uint32(1 << j)))) for j in range(32)]))
    return tables


_shifts: list[np.ndarray] = []


def appended(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a text with another appended, from both CRCs and the other's length in bytes."""
    if not _shifts:
        _shifts.extend(_shift_tables())
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        if len(at):
            t, c = _shifts[k], out[at]
            out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out ^ more


class Dictionary:
    """The automaton of some words, with their payloads."""

    def __init__(self, words: list[str]):
        self.auto = ahocorasick.Automaton()
        raw = [w.encode() for w in words]
        for i, w in enumerate(words):
            self.auto.add_word(f" {w} ", i)
        self.auto.make_automaton()
        self.crc = np.array([*map(zlib.crc32, raw), 0], np.uint32)
        self.length = np.array([*map(len, raw), 0], np.int64)

    def payloads(self, text: str):
        """text: flat, with blanks at both ends. CRC, length in bytes and start of each word."""
        blank = np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        which = np.full(len(ends), -1, np.int64)
        if len(self.crc) > 1:
            hits = np.fromiter(itertools.chain.from_iterable(self.auto.iter(text)), np.int64).reshape(-1, 2)
            which[np.searchsorted(ends, hits[:, 0])] = hits[:, 1]
        crc, length = self.crc[which], self.length[which]
        for k in np.flatnonzero(which < 0):
            word = text[starts[k] : ends[k]].encode()
            crc[k], length[k] = zlib.crc32(word), len(word)
        return crc, length, starts

    def histograms(self, texts: list[str | None], orders: tuple[int, int], buckets: int):
        """Features, and sorted buckets with their counts, of each text."""
        texts = [flat(t) for t in texts]
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        crc, length, starts = self.payloads(f" {' '.join(texts)} ")
        doc = np.searchsorted(offsets, starts, side="right") - 1
        blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
        keys, run = [], crc
        for n in range(1, orders[1] + 1):
            if n > 1:
                m = max(len(crc) - n + 1, 0)
                one = np.ones(m, np.int64)
                run = appended(appended(run[:m], blank[:m], one), crc[n - 1 :], length[n - 1 :])
            if n >= orders[0]:
                inside = doc[: len(run)] == doc[n - 1 :]
                keys.append((doc[: len(run)] * buckets + run % np.uint32(buckets))[inside])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        at = np.searchsorted(key, np.arange(len(texts) + 1) * buckets)
        total = np.concatenate(([0], np.cumsum(count)))
        return total[at[1:]] - total[at[:-1]], at, key % buckets, count


def _sliced(texts: list[str | None]):
    """(first, last) of runs of texts to scan together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > _SLICE:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of all documents, by levels of counts; no more of them than fit come to the driver. A
    task passes on its own most frequent words alone: which words are here changes the speed, not the result."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _sliced(texts):
                counts = Counter(w for t in texts[a:b] if t for w in flat(t).split(" ") if w and len(w) <= WORD_CHARS)
                top = counts.most_common(size)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    with scratch(docs.sparkSession):
        every = docs.select("text").mapInArrow(run, "word string, n long")
        level = F.floor(F.log2("n") * 4)  # under 256 levels, whatever the counts
        words = cut(every.groupBy("word").agg(F.sum("n").alias("n")).select("word", level.alias("level")), "counts")
        held, least, part = 0, 0, 0  # levels from least on fit whole, and so many words of the next one
        for r in sorted(words.groupBy("level").count().collect(), reverse=True):
            least, part = r["level"], min(r["count"], size - held)
            held += part
            if part < r["count"]:
                break
        above = words.where(F.col("level") > least).select("word")
        found = [w["word"] for w in above.unionByName(words.where(F.col("level") == least).select("word").limit(part)).collect()]
    return found


_kept: dict[str, Dictionary] = {}


def _automaton(name: str, shared) -> Dictionary:
    """This process' automaton of the broadcast words; one at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Dictionary(shared.value)
    return _kept[name]


def histograms(texts: DataFrame, key: str, shared, orders=(1, 1), buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, buckets, counts (arrays) of every text. shared: the broadcast dictionary."""
    name = uuid.uuid4().hex
    d = texts.select(key, "text")
    kind = d.schema[key].dataType.simpleString()

    def run(batches):
        known = _automaton(name, shared)
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in _sliced(values):
                n, at, bucket, count = known.histograms(values[a:b], orders, buckets)
                ends = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))],
                    names=[key, "n_features", "buckets", "counts"])

    return d.mapInArrow(run, f"{key} {kind}, n_features long, buckets array<int>, counts array<int>")


def _counted(found: DataFrame, name: str) -> DataFrame:
    each = found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """docs, target: histograms. 1000 times the logarithm of how much likelier a bucket is in the target,
    smoothed by one a bucket, rounded down."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    d = every.join(_counted(docs, "s"), "bucket", "left").join(_counted(target, "t"), "bucket", "left")
    found = np.zeros((buckets, 2), np.int64)
    for r in d.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect():  # a row a bucket
        found[r["bucket"]] = r["s"], r["t"]
    s, t = found[:, 0], found[:, 1]
    ratio = (t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found: histograms (doc_id first). doc_id, n_features, weight: the mean gain of its features, rounded down."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, lists, counts = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            at = lists.offsets.to_numpy().astype(np.int64)
            each = gain[lists.values.to_numpy()] * counts.values.to_numpy().astype(np.int64)
            total = np.concatenate(([0], np.cumsum(each)))
            weight = (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "weight"])

    return found.select("doc_id", "n_features", "buckets", "counts").mapInArrow(run, f"doc_id {kind}, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, rounded down, from a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_features, weight, score) with `rank` of the drawn: of the documents of least_words
    words, share percent."""
    able = F.col("n_features") >= least_words
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    d = scored.withColumn("able", able)
    d = cut(d.repartitionByRange(*order).sortWithinPartitions(*order), "drawn")
    files = d.where("able").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()  # a row a task of the sort
    before, total = [], 0
    for r in sorted(files, key=lambda r: r["file"]):
        before.append((r["file"], total))
        total += r["n"]
    drawn = total * share // 100
    offsets = d.sparkSession.createDataFrame(before, "file string, before long")
    d = d.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).join(F.broadcast(offsets), "file", "left")
    place = F.col("before") + F.col("at") + 1
    return d.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (place <= drawn), place).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, orders=(1, 1), buckets: int = BUCKETS,
              least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), target (text) to doc_id, n_features, weight, score and rank (null: not drawn)."""
    words = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    own = cut(histograms(docs, "doc_id", words, orders, buckets), "histograms")
    gain = gains(own, histograms(target.select(F.lit(0).alias("key"), "text"), "key", words, orders, buckets), buckets)
    words.destroy()  # both are read
    return ranked(weighed(own, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), share, least_words)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
                    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
e AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM e UNION SELECT w FROM b)),
c AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
                    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) % 10000 AS bucket FROM h, tbl),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM e JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, sum(n * gain)::BIGINT AS total FROM e JOIN c USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w)::BIGINT AS n_features,
             CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
q AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END::BIGINT AS rank FROM k
"""
