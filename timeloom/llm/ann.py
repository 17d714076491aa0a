"""Nearest neighbours by score-aware product quantisation.

The smallest Euclidean distance is the largest inner product q.x - |x|^2/2, from any origin (the sample's mean); the
norm is stored exactly and x is quantised in pairs of dimensions to 4 bits each. Codebooks and codes minimise a loss
that weighs the residual parallel to x more than the rest, as that is what moves the inner product of
the queries that matter. A scan adds up two codes a byte from 256-entry tables, block by block; the
best `rerank` of each query in a block are measured on the original vectors.

Codes say little about vectors that lie closer together than codewords do, are much shorter than most, or are all about as far from
each other. So each row also keeps the length of its residual, which bounds its distance from below: rows that the bound
doesn't put behind the nearest measured so far are measured too. What is returned is thus exact on any rows; on
rows without structure a scan measures most of them, by blocks, in the tasks where they lie.

Equal vectors are one class with its k + 1 least ids: scans and the nearest are over classes, and
copies come back after the exact measurement, so that they take no place of another vector.

The codebook is fitted on at most SAMPLE distinct vectors, those of least hash, on the driver (bounded:
SAMPLE vectors; a few numbers a component of them), and is broadcast (16 vectors of the full length). Every
distinct vector is encoded, and the codes are a table that is scanned where it lies: queries are broadcast
to it in waves of about QUERY_WAVE vectors, so that neither codes nor queries are copied by a shuffle.

Cases: vectors that are null, zero, or hold a null or non-finite component, and null ids, take no
part, nor do vectors of another length than the most common one (of equally common ones, the longest);
ties go to the smaller id; repeated rows are candidates each, a repeated query id is searched once, by
its least vector; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, load

SAMPLE = 8192
RERANK = 128
#: Queries that are broadcast at once; rows of a block that is scanned at once.
QUERY_WAVE = 2048
ROW_BLOCK = 8192
CODES = 16
#: Queries whose cosine with x is at least this are those that the loss has in mind.
THRESHOLD = 0.2
_ROUNDS = 6
_LAST = np.iinfo(np.int64).max


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is above infinity
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _pairs(dim: int) -> int:
    return -(-dim // 4) * 2  # pairs of dimensions, an even number of them


def _padded(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 2 * _pairs(x.shape[1])))
    out[:, : x.shape[1]] = x
    return out


def _length(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1))
    return np.where(size > 0, size, 1.0)  # a vector at the origin has no direction


def _parallel_weight(dim: int) -> float:
    """Weight of the parallel residual over that of the orthogonal one."""
    return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows, pairs) by coordinate descent on |r|^2 + (eta - 1) (r.u)^2, u: direction of x."""
    n, m = len(x), books.shape[0]
    parts = x.reshape(n, m, 2)
    u = parts / _length(x)[:, None, None]
    plain = ((parts[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    along = ((parts[:, :, None, :] - books[None]) * u[:, :, None, :]).sum(axis=3)
    codes = plain.argmin(axis=2)
    at = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[at, j, codes[:, j]]
            codes[:, j] = (plain[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
            total = rest + along[at, j, codes[:, j]]
    return codes


def fit(sample: np.ndarray) -> np.ndarray:
    """Codebooks (pairs, 16, 2) for the rows of sample; deterministic."""
    x = _padded(sample.astype(np.float64))
    n, m = len(x), x.shape[1] // 2
    eta = _parallel_weight(sample.shape[1])
    parts = x.reshape(n, m, 2)
    order = np.argsort(np.arctan2(parts[..., 1], parts[..., 0]), axis=0, kind="stable")
    picks = order[np.linspace(0, n - 1, CODES).astype(int)]
    books = np.take_along_axis(parts, picks[:, :, None], axis=0).transpose(1, 0, 2).copy()
    u = x / _length(x)[:, None]
    xu = (x * u).sum(axis=1)
    u = u.reshape(n, m, 2)
    for _ in range(_ROUNDS):
        codes = np.concatenate([encode(x[at : at + 512], books, eta, 1) for at in range(0, n, 512)])
        along = sum((books[j][codes[:, j]] * u[:, j]).sum(axis=1) for j in range(m))
        # Least squares pair by pair, the others held: a system of two unknowns a codeword.
        for j in range(m):
            code, w = codes[:, j], u[:, j]
            rest = along - (books[j][code] * w).sum(axis=1)
            over = lambda v: np.bincount(code, weights=v, minlength=CODES)
            a = np.empty((CODES, 2, 2))
            for p in range(2):
                for q in range(2):
                    a[:, p, q] = (eta - 1) * over(w[:, p] * w[:, q]) + (over(np.ones(n)) + 1e-6 if p == q else 0.0)
            b = np.stack([over(parts[:, j, p] + (eta - 1) * w[:, p] * (xu - rest)) for p in range(2)], axis=1) + 1e-6 * books[j]
            books[j] = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            along = rest + (books[j][code] * w).sum(axis=1)
    return books


def _tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of each query with each pair of codewords: (queries, bytes, 256)."""
    single = np.einsum("qmd,mcd->qmc", _padded(queries).reshape(len(queries), -1, 2), books)
    return (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def _classes(data: DataFrame, k: int) -> DataFrame:
    """data (vec_id, vector) to a row for each distinct vector: class_id, vector, ids (the least k + 1
    in order, structs of vec_id and n, the rows that have it)."""
    ids = data.groupBy("vector", "vec_id").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("vector"))
    place = F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))
    ids = ids.withColumn("place", place).where(F.col("place") <= k + 1)
    found = ids.groupBy("key", "vector").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    return cut(found.select(F.monotonically_increasing_id().alias("class_id"), "vector", "ids"), "classes")


class Wave:
    """Queries that are sent to the codes together, and what a scan of a block of codes finds for them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, books: np.ndarray, centre: np.ndarray, keep: int, rerank: int):
        self.ids, self.vectors, self.books, self.centre, self.keep, self.rerank = ids, vectors, books, centre, keep, rerank

    def scan(self, rows: pa.RecordBatch, best=None):
        """Distances, least ids and classes of the nearest of a block and of `best` (those of the blocks before), a row a
        query; inf where there are none. Scores of the codes say which rows are measured first. What they leave
        is measured too, unless a row's code and its residual put it farther away than the nearest found so far."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._scan(rows, best)

    def _scan(self, rows: pa.RecordBatch, best):
        classes, least, single = (rows[c].to_numpy(zero_copy_only=False) for c in ("class_id", "least", "single"))
        half, coded, residual = (rows[c].to_numpy() for c in ("half_norm", "code_norm", "residual"))
        width, dim = self.books.shape[0] // 2, self.vectors.shape[1]
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, width)
        x = np.asarray(rows["vector"].flatten()).reshape(-1, dim)
        moved, norm = x - self.centre, np.sqrt(2 * half)
        out = []
        for at in range(0, len(self.ids), 64):
            asked, ids = self.vectors[at : at + 64], self.ids[at : at + 64]
            q = asked - self.centre
            size = np.sqrt((q * q).sum(axis=1))[:, None]
            lut = _tables(q, self.books)
            inner = np.zeros((len(q), len(x)), np.float32)
            for b in range(width):
                inner += lut[:, b][:, codes[:, b]]
            inner = inner.astype(np.float64)
            own = (ids[:, None] == least[None]) & single
            found = [c[at : at + 64] for c in best] if best else self.nothing(len(q))
            score = np.where(own | ~np.isfinite(inner), -np.inf, inner - half[None])
            first = np.argpartition(-score, self.rerank, axis=1)[:, : self.rerank] if self.rerank < len(x) else np.broadcast_to(np.arange(len(x)), score.shape)
            met = own.copy()
            np.put_along_axis(met, first, True, axis=1)
            i = np.repeat(np.arange(len(q)), first.shape[1])
            seen = ~own[i, first.ravel()]
            found = self.taken(found, i[seen], first.ravel()[seen], asked, x, least, classes)
            # |q - x| >= ||q - code| - residual| and >= ||q| - |x||; errors of 32-bit sums are allowed for.
            square, slack = size**2 + coded[None] ** 2 - 2 * inner, 2.0**-21 * (width + 4) * size * (coded[None] + 1e-300)
            low = np.sqrt(np.maximum(square - slack, 0)) - residual[None]
            high = residual[None] - np.sqrt(np.maximum(square + slack, 0))
            apart = np.where(np.isfinite(inner), np.maximum(low, high), 0)
            apart = np.maximum(apart, np.abs(size - norm[None])) - 1e-9 * (size + norm[None])
            far = found[0][:, -1:]
            waiting = ~met & ~(apart > far)
            some = np.flatnonzero(waiting.any(axis=0))
            for lo in range(0, len(some), 1024):
                part = some[lo : lo + 1024]
                square = size**2 + norm[None, part] ** 2 - 2 * (q @ moved[part].T)
                near = waiting[:, part] & ~(square - 2.0**-50 * (dim + 8) * (size + norm[None, part]) ** 2 > found[0][:, -1:] ** 2 * (1 + 1e-12))
                i, j = np.nonzero(near)
                found = self.taken(found, i, part[j], asked, x, least, classes)
            out.append(found)
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def nothing(self, n: int):
        return [np.full((n, self.keep), np.inf), np.full((n, self.keep), _LAST), np.full((n, self.keep), _LAST)]

    def taken(self, found, i, j, asked, x, least, classes):
        """found with the rows j of the queries i (in order), measured exactly as the result is."""
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536], j[at : at + 65536]
            square = np.zeros(len(a))
            for d in range(x.shape[1]):
                gap = asked[a, d] - x[b, d]
                square += gap * gap
            distance = np.sqrt(square)
            order = np.lexsort((classes[b], least[b], distance, a))
            a, b, distance = a[order], b[order], distance[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < self.keep
            more = self.nothing(len(asked))
            for c, values in zip(more, (distance, least[b], classes[b]), strict=True):
                c[a[top], place[top]] = values[top]
            found = self.better(found, more)
        return found

    def better(self, a, b):
        """The best of two scans."""
        value, least, classes = (np.concatenate(c, axis=1) for c in zip(a, b, strict=True))
        best = np.lexsort((classes, least, value), axis=1)[:, : self.keep]
        return [np.take_along_axis(c, best, axis=1) for c in (value, least, classes)]

    def rows(self, found) -> pa.RecordBatch:
        value, least, classes = found
        real = classes < _LAST
        ids = np.repeat(self.ids, value.shape[1])[real.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, classes[real], least[real], value[real])], names=["query_id", "class_id", "least", "distance"])


def _scanned(codes: DataFrame, ask: DataFrame, n_queries: int, books: np.ndarray, centre: np.ndarray, keep: int, rerank: int) -> DataFrame:
    """The nearest `keep` classes of each query; a task hands out that many a query, whatever it has scanned. Codes stay where they are; queries come
    to them in waves of about QUERY_WAVE, which are broadcast: their size is bounded, whatever the tables."""
    spark, waves = codes.sparkSession, max(1, -(-n_queries // QUERY_WAVE))
    wave = F.pmod(F.xxhash64("query_id"), F.lit(waves))
    schema, found = "query_id long, class_id long, least long, distance double", []
    for k in range(waves):
        rows = ask.where(wave == k).orderBy("query_id").toPandas()
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast(Wave(rows["query_id"].to_numpy(), np.array(rows["vector"].tolist(), np.float64), books, centre, keep, rerank))

        def run(batches, shared=shared):
            wave, best, held, n = shared.value, None, [], 0
            block = lambda held: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= ROW_BLOCK:
                    best, held, n = wave.scan(block(held), best), [], 0
            if n:
                best = wave.scan(block(held), best)
            if best is not None:
                yield wave.rows(best)

        best = Window.partitionBy("query_id").orderBy("distance", "least", "class_id")
        some = codes.mapInArrow(run, schema).withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
        found.append(cut(some.select("query_id", "class_id"), "found"))
        shared.destroy()  # its table is written
    return functools.reduce(DataFrame.unionByName, found)


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found of each query.
    queries: rows with the same columns as table; a query's own id is no candidate."""
    def clean(df):
        d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return d.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))

    data = clean(table)
    result = "query_id long, rank int, vec_id long, score double"
    sizes = data.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return table.sparkSession.createDataFrame([], result)
    dim = common["dim"]
    classes = _classes(data.where(F.size("vector") == dim), k)
    ask = clean(queries).where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    ask = ask.withColumnRenamed("vec_id", "query_id")
    sample = np.array(classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toPandas()["vector"].tolist())
    centre = sample.mean(axis=0)
    books, eta = fit(sample - centre), _parallel_weight(dim)

    def encoded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.asarray(part.column(1).flatten()).reshape(-1, dim) - centre
                if len(x):
                    codes = encode(_padded(x), books, eta).astype(np.uint8)
                    near = books[np.arange(books.shape[0])[None], codes].reshape(len(x), -1)
                    packed = codes[:, 0::2] * CODES + codes[:, 1::2]
                    numbers = (x * x).sum(axis=1) / 2, np.sqrt((near * near).sum(axis=1)), np.sqrt(((_padded(x) - near) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, numbers), pa.array([r.tobytes() for r in packed], pa.binary())],
                                                     names=[*part.schema.names, "half_norm", "code_norm", "residual", "codes"])

    codes = classes.select("class_id", "vector", "ids", F.col("ids")[0]["vec_id"].alias("least"), (F.size("ids") == 1).alias("single"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in codes.schema)
    n_queries = ask.count()
    if not n_queries:
        return table.sparkSession.createDataFrame([], result)
    codes = cut(codes.mapInArrow(encoded, f"{shape}, half_norm double, code_norm double, residual double, codes binary"), "codes")
    discard(classes)
    found = _scanned(codes.drop("ids"), ask, n_queries, books, centre, k + 1, rerank)
    classes = codes.select("class_id", "vector", "ids")
    pairs = found.join(classes, "class_id").join(ask.withColumnRenamed("vector", "asked"), "query_id")
    square = F.aggregate(F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    others = F.filter("ids", lambda c: c["vec_id"] != F.col("query_id"))
    pairs = pairs.select("query_id", F.sqrt(square).alias("score"), F.explode(others).alias("c"))
    pairs = pairs.select("query_id", "score", "c.vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least("c.n", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    return nearest(table, table.where(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id,
             sqrt(list_reduce(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
      FROM e AS q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
