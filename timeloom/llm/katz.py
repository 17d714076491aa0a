"""Katz backoff over word pairs: Good-Turing discounts, exactly normalised backoff weights.

P(w|v) is d(c(vw)) c(vw) / c(v) for pairs seen in training, else a(v) P1(w); P1 is the Good-Turing
discounted share of w, and what the discounts free goes to one unknown word. Counts up to K are
discounted by Good-Turing, greater ones lose TAIL, so that every context has mass to hand on. a(v) is
(1 - sum P(w|v)) / (1 - sum P1(w)) over the words seen after v: over all words and the unknown one
P(.|v) adds up to 1. Contexts are the word before or the start of the text; each text ends with one end
token.

Texts are worked on in chunks. A chunk's pairs, each with its documents, go by their second word to a
bucket of bounded size, where c(vw) and c(w) are counted and each document gets its share of the sums
at once. The n-gram table (context, count, P1 of the word) is written to the shared folder, bucket by
bucket, and gives the discounts and the weights a(v). Words with a share of 1/HEAVY or more are at most
HEAVY in number: their counts are broadcast, and their pairs are dealt by both words. Buckets are
worked on in ROUNDS, which bounds the shuffle on disk.

Pairs with a share of 1.25/HEAVY or more (and some of 1/HEAVY or more) are hot, HEAVY at most. Their
postings are never shuffled: the first round only counts them, with one number a chunk, their counts are
broadcast, and in the last round each chunk adds up their part of its documents' sums itself. Every
other pair has a bounded share of all tokens.

The order is two: a table of trigrams doesn't fit the disk allowed (README has the figures). A bucket's
blobs are one a chunk that it meets, never more than its postings, and hold the documents that occur in
it.

Tables in between belong to the `scratch` block around the call. Words are known by 64 bits of a hash;
very long texts are chunks of their own. Cases: a null text is empty (one token, the end); null ids are
training rows; repeated rows count in training each and are scored each; without training tokens
every token is unknown and scores 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, held_out, load

K = 5
TAIL = 0.5
HEAVY = 4096
ROUNDS = 2
#: Tokens of a chunk, at most 65,535 documents; tokens of a bucket, on average.
CHUNK = 1_000_000
BUCKET = 2_000_000


def _key(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


# No word holds a blank.
END, START = _key(b" end"), _key(b" start")


def discounts(counts_of_counts: dict[int, int], k: int = K) -> list[float]:
    """Factors d(1)..d(k) by Katz's form of Good-Turing. A count whose factor would not lie between 0
    and 1 (too few counts of counts) loses TAIL instead."""
    n = counts_of_counts
    out = []
    spare = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        d = -1.0
        if spare < 1 and n.get(r):
            d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - spare) / (1 - spare)
        out.append(d if 0 < d < 1 else (r - TAIL) / r)
    return out


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts after discounting, 0 for 0."""
    table = np.array([0.0, *(r * x for r, x in enumerate(d, 1))])
    return np.where(c <= len(d), table[np.minimum(c, len(d))], c - TAIL)


class _Chunk:
    """Tokens of several texts: word numbers, contexts and documents, and what the numbers stand for."""

    def __init__(self):
        self.number = defaultdict(itertools.count().__next__)
        self.ids, self.tags, self.train, self.sizes, self.tokens = [], [], [], [], []
        self.held = 0

    def add(self, doc_id, out: bool, text: bytes) -> None:
        words = text.translate(LOWER).split()
        words.append(b" end")
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.ids.append(doc_id)
        self.tags.append(xxhash.xxh3_64_intdigest(text) >> 1)
        self.train.append(not out)
        self.sizes.append(len(words))
        self.held += len(words)

    def keys(self) -> np.ndarray:
        """Hashes by word number, that of the start last."""
        return np.append(np.fromiter(map(_key, self.number), np.int64, len(self.number)), START)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens, of the tokens before them and of their documents."""
        w = np.concatenate(self.tokens)
        ends = np.cumsum(self.sizes)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[ends - self.sizes] = len(self.number)  # the start
        return w, v, np.repeat(np.arange(len(ends)), self.sizes)


def _chunked(batches):
    """Batches of (doc_id, out, text) to chunks; a longer text is a chunk alone."""
    chunk = _Chunk()
    for batch in batches:
        for i, out, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
            chunk.add(i.as_py(), out.as_py(), text.as_py() or b"")
            if chunk.held >= CHUNK or len(chunk.ids) == 65_535:
                yield chunk
                chunk = _Chunk()
    if chunk.ids:
        yield chunk
    pa.default_memory_pool().release_unused()  # else what the largest batch took stays with the process


def counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, out, text) to word, before, n: counts in training texts, the end included. Rows with a
    word before are frequent pairs: a chunk leaves out those with less than 1/(4 HEAVY) of its tokens, so
    that n falls short of the pair's count by less than that share of all tokens."""
    least = 4 * HEAVY

    def run(batches):
        for c in _chunked(batches):
            w, v, doc = c.pairs()
            train = np.array(c.train)[doc]
            w, v, keys = w[train], v[train], c.keys()
            bits = len(keys).bit_length()
            n = np.bincount(w, minlength=len(keys))
            seen = np.flatnonzero(n)
            pair, times = np.unique((w << bits) | v, return_counts=True)
            often = times * least >= len(w)
            pair, times = pair[often], times[often]
            before = pa.chunked_array([pa.nulls(len(seen), pa.int64()), pa.array(keys[pair & ((1 << bits) - 1)])])
            yield from pa.table({"word": np.concatenate((keys[seen], keys[pair >> bits])), "before": before,
                                 "n": np.concatenate((n[seen], times))}).combine_chunks().to_batches()

    return docs.mapInArrow(run, "word long, before long, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)) % np.uint64(n)


def _codes(keys: np.ndarray, bits: int, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of hashes (v, w) that a chunk may hold, by its own numbers in order, and their places."""
    order = np.argsort(keys)

    def number(x):
        n = order[np.minimum(np.searchsorted(keys, x, sorter=order), len(keys) - 1)]
        return np.where(keys[n] == x, n, -1)

    v, w = number(v), number(w)
    place = np.flatnonzero((v >= 0) & (w >= 0))
    code = (w[place] << bits) | v[place]
    order = np.argsort(code)
    return code[order], place[order]


def _postings(docs: DataFrame, buckets: int, part: int, heavy: np.ndarray, hot: tuple[np.ndarray, np.ndarray], terms: list[np.ndarray] | None) -> DataFrame:
    """bucket, chunk, blob of the buckets of one round; bucket -1 - chunk holds a chunk's documents, and
    with `terms` (what one occurrence of each hot pair adds) their sums over hot pairs. Hot pairs are
    filed without postings, in buckets of the first round."""
    schema = "bucket long, chunk long, blob binary"

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for order, c in enumerate(_chunked(batches)):
            chunk = xxhash.xxh3_64_intdigest(np.array(c.tags, np.int64).tobytes(), (TaskContext.get().partitionId() << 20) + order) >> 1
            w, v, doc = c.pairs()
            keys = c.keys()
            bits = len(keys).bit_length()
            code, times = np.unique((((w << bits) | v) << 16) | doc, return_counts=True)
            at, doc = code >> 16, code & 0xFFFF
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            vk, wk = keys[at[first] & ((1 << bits) - 1)], keys[at[first] >> bits]
            seen = np.add.reduceat(np.where(np.array(c.train)[doc], times, 0), first)
            lens = np.diff(np.append(first, len(at)))
            word = at[first] >> bits
            bucket = _spread(keys, buckets).astype(np.int64)[word]
            often = np.isin(keys, heavy)[word]
            bucket[often] = _spread(wk[often] ^ (vk[often] >> 7) ^ (vk[often] << 9), buckets)
            codes, place = _codes(keys, bits, *hot)
            found = np.minimum(np.searchsorted(at[first], codes), len(first) - 1)
            is_hot = np.zeros(len(first), bool)
            is_hot[found[at[first[found]] == codes]] = True
            bucket[is_hot] -= bucket[is_hot] % ROUNDS
            sums = {}
            if terms is not None:
                mine = np.repeat(is_hot, lens)
                which = place[np.searchsorted(codes, at[mine])]
                sums = {s: np.bincount(doc[mine], x[which] * times[mine], len(c.ids)) for s, x in zip(_SUMS, terms, strict=True)}
            lens[is_hot] = 0
            mine = np.flatnonzero(bucket % ROUNDS == part)
            sort = mine[np.argsort(bucket[mine].astype(np.min_scalar_type(buckets)), kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[sort], prepend=-1))
            rows = []
            for k in np.split(sort, cuts[1:]) if len(sort) else ():
                entries = np.arange(lens[k].sum()) + np.repeat(first[k] - (np.cumsum(lens[k]) - lens[k]), lens[k])
                blob = b"".join((np.array([len(k), len(entries), len(c.ids)], np.int64).tobytes(), vk[k].tobytes(), wk[k].tobytes(),
                                 seen[k].astype(np.int64).tobytes(), lens[k].astype(np.int32).tobytes(),
                                 times[entries].astype(np.int32).tobytes(), doc[entries].astype(np.uint16).tobytes()))
                rows.append((int(bucket[k[0]]), chunk, pack(blob)))
            table = pa.table({"id": pa.array(c.ids, pa.int64()), "tag": np.array(c.tags, np.int64), "out": [not t for t in c.train], "n": np.array(c.sizes, np.int64), **sums})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            rows.append((-1 - chunk, chunk, sink.getvalue().to_pybytes()))
            for at in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 16], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                                 names=["bucket", "chunk", "blob"])

    return docs.mapInArrow(run, schema)


class Unigram:
    """Counts' totals and P1: training tokens, distinct ones, the discounts and the unknown word's share."""

    def __init__(self, counts_of_counts: dict[int, int], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.d = discounts(counts_of_counts)
        kept = sum(n * (r * self.d[r - 1]) for r, n in counts_of_counts.items() if r <= K)
        tail = distinct - sum(n for r, n in counts_of_counts.items() if r <= K)
        large = total - sum(r * n for r, n in counts_of_counts.items() if r <= K)
        self.unknown = (total - kept - (large - TAIL * tail)) / total if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d) / max(self.total, 1), self.unknown)


#: Sums of a document: known tokens, base, log10 c of its known contexts, seen pairs with counts 1..K,
#: log10 of the discounted counts above K, log10 P1 of words in unseen pairs.
_SUMS = ["known", "base", "context", *(f"seen{r}" for r in range(1, K + 1)), "tail", "backed"]
_OUT = "kind int, chunk long, v long, c long, x double, doc int, n long, blob binary"


def _terms(uni: Unigram, c: np.ndarray, cw: np.ndarray, p1: np.ndarray, is_word: np.ndarray) -> list[np.ndarray]:
    """What one occurrence of each pair adds to _SUMS. c: counts of pairs; cw, p1: counts and shares of
    their second words; is_word: these aren't the end."""
    with np.errstate(divide="ignore"):
        return [
            (cw > 0) * 1.0,
            np.log10((cw + 0.1) / (uni.total + 0.1 * (uni.distinct + 1))),
            np.where((cw > 0) & is_word, np.log10(np.maximum(cw, 1)), 0.0),
            *((c == r) * 1.0 for r in range(1, K + 1)),
            np.where(c > K, np.log10(np.maximum(c, 1) - TAIL), 0.0),
            np.where(c == 0, np.log10(p1), 0.0),
        ]


def _evaluate(blobs: pa.Table, uni: Unigram, heavy: np.ndarray, heavy_n: np.ndarray) -> pa.Table:
    """One bucket's postings to rows of four kinds. 0: pairs seen in training (v, c, x: P1 of the word);
    1: unseen pairs in documents (chunk, doc, v, n); 2: sums of each document of a chunk (blob); 4: hot
    pairs, which have no postings (v, c, n: the second word)."""
    unpack = zstandard.ZstdDecompressor().decompress
    chunks, ids, parts, n_docs = [], [], [], []
    for chunk, data in zip(blobs["chunk"].to_pylist(), blobs["blob"], strict=True):
        data, at, got = unpack(data.as_py()), 24, []
        pairs, entries, docs = np.frombuffer(data, np.int64, 3).tolist()
        for kind, n in ((np.int64, pairs), (np.int64, pairs), (np.int64, pairs), (np.int32, pairs), (np.int32, entries), (np.uint16, entries)):
            got.append(np.frombuffer(data, kind, n, at))
            at += got[-1].nbytes
        chunks.append(chunk)
        parts.append(got)
        n_docs.append(docs)
        ids.append(got[5].astype(np.int64) + sum(n_docs[:-1]))
    v, w, seen, lens, times = (np.concatenate([p[i] for p in parts]) for i in range(5))
    doc = np.concatenate(ids)
    order = np.lexsort((v, w))
    new_w = np.concatenate(([True], w[order][1:] != w[order][:-1]))
    new = new_w | np.concatenate(([True], v[order][1:] != v[order][:-1]))
    pair, word = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    pair[order], word[order] = np.cumsum(new) - 1, np.cumsum(new_w) - 1
    c = np.bincount(pair, weights=seen).astype(np.int64)
    cw = np.bincount(word, weights=seen).astype(np.int64)
    words = w[order][new_w]
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
        cw = np.where(heavy[at] == words, heavy_n[at], cw)
    p1 = uni.p(cw)
    # Rows of the n-gram table, one a distinct pair.
    pv, pw = v[order][new], word[order][new]
    known = c > 0
    # Sums over entries: what a pair adds, times its occurrences in the document.
    per = lambda x: np.repeat(x[pair], lens) * times
    columns = _terms(uni, c, cw[pw], p1[pw], words[pw] != END)
    # Sums of the documents that occur here: never more of them than postings.
    here, place = np.unique(doc, return_inverse=True)
    sums = np.stack([np.bincount(place, weights=per(x), minlength=len(here)) for x in columns], axis=1)
    pack = zstandard.ZstdCompressor(level=1).compress
    starts = np.concatenate(([0], np.cumsum(n_docs)[:-1])).tolist()
    cuts = np.searchsorted(here, [*starts, sum(n_docs)]).tolist()
    blob = [pack((here[a:b] - s).astype(np.uint16).tobytes() + sums[a:b].tobytes()) for a, b, s in zip(cuts, cuts[1:], starts, strict=False)]
    lost = np.flatnonzero(np.repeat(c[pair] == 0, lens))
    owner = np.searchsorted(np.array(starts), doc[lost], side="right") - 1
    hot = np.flatnonzero(np.bincount(pair, weights=lens) == 0)
    n0, n1, n2, n4 = int(known.sum()), len(lost), len(blob), len(hot)
    fill = lambda a, b, d, e, t: pa.chunked_array([pa.array(x, t) if x is not None else pa.nulls(n, t) for x, n in ((a, n0), (b, n1), (d, n2), (e, n4))])
    return pa.table({
        "kind": fill(np.zeros(n0, np.int32), np.ones(n1, np.int32), np.full(n2, 2, np.int32), np.full(n4, 4, np.int32), pa.int32()),
        "chunk": fill(None, np.array(chunks, np.int64)[owner], chunks, None, pa.int64()),
        "v": fill(pv[known], np.repeat(v, lens)[lost], None, pv[hot], pa.int64()),
        "c": fill(c[known], None, None, c[hot], pa.int64()),
        "x": fill(p1[pw][known], None, None, None, pa.float64()),
        "doc": fill(None, (doc[lost] - np.array(starts)[owner]).astype(np.int32), None, None, pa.int32()),
        "n": fill(None, times[lost].astype(np.int64), None, words[pw[hot]], pa.int64()),
        "blob": fill(None, None, blob, None, pa.binary()),
    })


def _documents(rows: pa.Table) -> pa.Table:
    """All sums and the document list of a chunk to a row a document."""
    unpack = zstandard.ZstdDecompressor().decompress
    kinds = rows["kind"].to_pylist()
    listed = pa.ipc.open_stream(rows["blob"][kinds.index(3)].as_py()).read_all()
    if _SUMS[0] in listed.column_names:
        total = np.stack([listed[c].to_numpy() for c in _SUMS], axis=1)
    else:
        total = np.zeros((listed.num_rows, len(_SUMS)))
    for kind, data in zip(kinds, rows["blob"], strict=True):
        if kind != 3:
            data = unpack(data.as_py())
            n = len(data) // (2 + 8 * len(_SUMS))
            total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data[2 * n :]).reshape(n, len(_SUMS))
    out = {"chunk": pa.array(np.full(listed.num_rows, rows["chunk"][0].as_py(), np.int64)), "doc": pa.array(np.arange(listed.num_rows, dtype=np.int32))}
    return pa.table({**out, **{c: listed[c] for c in ("id", "tag", "out", "n")}, **{c: total[:, i] for i, c in enumerate(_SUMS)}})


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, out, text), out: not to be learnt from. Returns doc_id, out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probabilities of the text)."""
    spark = docs.sparkSession
    stored = cut(counts(docs), "unigrams")
    counted = stored.where("before is null")
    total, distinct = (x or 0 for x in counted.agg(F.sum("n"), F.count("*")).first())
    low = {r["n"]: r["k"] for r in counted.where(F.col("n") <= K + 1).groupBy("n").agg(F.count("*").alias("k")).collect()}
    uni = Unigram(low, total, distinct)
    top = counted.where(F.col("n") * HEAVY >= F.lit(total)).where("n > 0").collect()  # HEAVY rows at most
    top = sorted((r["word"], r["n"]) for r in top)
    heavy, heavy_n = np.array([t[0] for t in top], np.int64), np.array([t[1] for t in top], np.int64)
    # HEAVY rows at most; the second words of these pairs are heavy.
    pairs = stored.where("before is not null").where(F.col("n") * HEAVY >= F.lit(total)).collect()
    pairs = sorted((r["before"], r["word"]) for r in pairs)
    hot = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    buckets = max(ROUNDS, math.ceil(total / BUCKET))

    def bucket(rows: pa.Table) -> pa.Table:
        if rows["bucket"][0].as_py() < 0:
            n = rows.num_rows
            return pa.table({"kind": np.full(n, 3, np.int32), "chunk": rows["chunk"], "v": pa.nulls(n, pa.int64()), "c": pa.nulls(n, pa.int64()),
                             "x": pa.nulls(n, pa.float64()), "doc": pa.nulls(n, pa.int32()), "n": pa.nulls(n, pa.int64()), "blob": rows["blob"]})
        return _evaluate(rows, uni, heavy, heavy_n)

    columns = ", ".join(f"{c} double" for c in _SUMS)
    schema = f"chunk long, doc int, id long, tag long, out boolean, n long, {columns}"
    tables, found, missed, times = [], [], [], {}
    for part in range(ROUNDS):
        terms = None
        if part == ROUNDS - 1 and pairs:
            c, cw = np.array([times[p] for p in pairs]), heavy_n[np.searchsorted(heavy, hot[1])]
            terms = _terms(uni, c, cw, uni.p(cw), hot[1] != END)
        done = cut(_postings(docs, buckets, part, heavy, hot, terms).groupBy("bucket").applyInArrow(bucket, _OUT), "ngrams")
        if part == 0:
            times = {(r["v"], r["n"]): r["c"] for r in done.where("kind = 4").collect()}  # as many as hot pairs
        tables.append(done.where("kind = 0").select("v", "c", "x"))
        listed = done.where("kind in (2, 3)").select("kind", "chunk", "blob").groupBy("chunk").applyInArrow(_documents, schema)
        found.append(listed)
        listed = cut(listed, "sums")
        found[-1] = listed
        missed.append(done.where("kind = 1").select("chunk", "doc", "v", "n").join(listed.select("chunk", "doc", "id", "tag"), ["chunk", "doc"]))
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    ngrams = union(tables)
    low = {r["c"]: r["k"] for r in ngrams.where(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("k")).collect()}
    d = discounts(low)
    lost = F.lit(TAIL)
    for r in range(1, K + 1):
        lost = F.when(F.col("c") == r, F.lit(r * (1 - d[r - 1]))).otherwise(lost)
    weights = ngrams.groupBy("v").agg(F.sum(lost).alias("freed"), F.sum("x").alias("covered"))
    # Tables of their own: Spark can then split the misses of a very common context.
    weights = cut(weights.select("v", F.log10(F.col("freed") / (1 - F.col("covered"))).alias("weight")), "weights")
    backed = union(missed).join(weights, "v").groupBy("id", "tag").agg(F.sum(F.col("n") * F.col("weight")).alias("weights"))
    starts = docs.where("not out").count()
    per_doc = union(found).groupBy("id", "tag", "out").agg(
        F.count("*").alias("rows"), F.max("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    copies = F.col("rows") / ROUNDS  # rows with the same id and text have the same sums
    key = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["tag"] == b["tag"])
    joined = per_doc.join(backed, key(per_doc, backed), "left").select(per_doc["*"], backed["weights"])
    likelihood = F.col("tail") + F.col("backed") - F.col("context") + F.coalesce("weights", F.lit(0.0))
    for r in range(1, K + 1):
        likelihood = likelihood + F.col(f"seen{r}") * math.log10(r * d[r - 1])
    likelihood = likelihood / copies - (math.log10(starts) if starts else 0.0)
    return joined.select(
        F.col("id").alias("doc_id"), "out", F.col("n").alias("n_tokens"), F.round(F.col("known") / copies).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / copies).alias("base_score"), likelihood.alias("score"),
        F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")).drop("copy")


def op2_katz_backoff(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 10, 0).alias("out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return score(docs).withColumnRenamed("out", "held_out")
