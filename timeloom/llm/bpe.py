"""Byte-level BPE by DuckDB recursive queries in each partition.

A text is split by the tokenizer's pattern; the words not met before by the worker become
token-position rows. A recursive query joins neighbouring rows with the merge table and contracts each
word's leftmost pair of least rank until no pair is left. Decoding joins ids with the vocabulary and
aggregates the pieces in order.

A recursion keeps every step, so a word of n bytes costs n * n rows. Words therefore go in as pieces of
at most PIECE bytes. Two neighbouring pieces are joined rightly if, and only if, the last token of one
and the first of the other come out unchanged when encoded together: what happens inside the spans of
two neighbouring tokens doesn't depend on what lies around them until a merge crosses their border, and
the first merge that does so would cross it as well with these two alone. Wherever that fails, what lies
on both sides of the border is encoded anew as one piece, until every border holds. The same query does
all of it, for any length.

The vocabulary (a file of the driver, given by path) and its merge table are broadcast: their size is
that of the vocabulary, whatever the corpus. A worker remembers two generations of words, each of
REMEMBER bytes, and hands DuckDB words of at most ROWS rows at once, so that it never spills; a Python
process keeps its worker for its next partitions.

Cases: a null text is empty; an empty text has no ids and decodes to no bytes; special tokens are
ordinary text; very long texts are encoded whole, very long words in linear time but for borders that
fail again and again; ids are not looked at, null ones pass through; repeated rows are encoded each for itself; an empty table gives an empty result;
further columns are ignored by `op7` and kept by `encode` and `decode`, but for an input's own columns
`ids` (encode) and `decoded` (decode), whose place the new ones take.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load

#: Bytes of a word that go into a recursion as one word.
PIECE = 96
#: Bytes of the words that a worker remembers, twice.
REMEMBER = 48_000_000
#: Rows of all steps of a recursion, at most: half the sum of squared lengths.
ROWS = 3_000_000
#: Ids decoded at once.
IDS = 400_000

# A row holds its token, its right neighbour (np, nt) and their pair's rank m. Each step finds a word's
# best pair by grouping, and then rewrites the row left of it, its first row, and drops its second one.
_STEP = """
WITH RECURSIVE s AS (
  SELECT w, p, t, np, nt, m, 0 AS k
  FROM (SELECT w, p, t, lead(p) OVER v AS np, lead(t) OVER v AS nt FROM start WINDOW v AS (PARTITION BY w ORDER BY p))
  LEFT JOIN merges ON t = l AND nt = r
  UNION ALL
  SELECT w, p, t, np, nt, merges.m, k + 1 AS k
  FROM (SELECT s.w, s.p, s.k, CASE WHEN s.p = hit THEN token ELSE s.t END AS t,
               CASE WHEN s.p = hit THEN beyond ELSE s.np END AS np,
               CASE WHEN s.p = hit THEN beyond_t WHEN s.np = hit THEN token ELSE s.nt END AS nt
        FROM s JOIN (SELECT b.w, best.p AS hit, best.m AS token, best.np AS gone, n.np AS beyond, n.nt AS beyond_t
                     FROM (SELECT w, arg_min({'p': p, 'm': m, 'np': np}, (m::BIGINT << 32) + p) AS best
                           FROM s WHERE m IS NOT NULL GROUP BY w) AS b
                     JOIN s AS n ON n.w = b.w AND n.p = best.np) AS found ON s.w = found.w
        WHERE s.p <> gone AND k < ?)
  LEFT JOIN merges ON t = l AND nt = r)
SELECT w, p, t, k FROM s JOIN (SELECT w, max(k) AS k FROM s GROUP BY w) USING (w, k) ORDER BY w, p
"""

_DECODE = """
SELECT d, string_agg(piece, '' ORDER BY p) AS piece FROM ids JOIN vocabulary ON t = id GROUP BY d ORDER BY d
"""


class Vocabulary:
    """Ranks (bytes to id) and every way to put a token together from two others."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(c, np.int32) for c in zip(*pairs, strict=True)) if pairs else [np.empty(0, np.int32)] * 3
        self.merges = pa.table({"l": left, "r": right, "m": merged})

    def key(self) -> str:
        """Tells vocabularies apart by their content."""
        return hashlib.sha256(repr((self.pattern, sorted(self.ranks.items()))).encode()).hexdigest()

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _pieces(word: bytes) -> list[bytes]:
    """Cuts of at most PIECE bytes, at the last change of byte if there is one: inside a run of one byte,
    cuts stand at even distances from its start."""
    out, at = [], 0
    while len(word) - at > PIECE:
        to = next((k for k in range(at + PIECE, at, -1) if word[k] != word[k - 1]), at + PIECE)
        out.append(word[at:to])
        at = to
    return [*out, word[at:]]


class Worker:
    """A process's DuckDB and the words that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.token = {rank: t for t, rank in vocabulary.ranks.items()}
        self.find = regex.compile(vocabulary.pattern).findall
        self.single = np.array([vocabulary.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # an earlier generation: what is met again moves on
        self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = vocabulary.merges  # noqa: F841  DuckDB sees it by name
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        words = pa.table({"id": pa.array(vocabulary.ranks.values(), pa.int32()), "piece": [t.hex() for t in vocabulary.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")

    def close(self) -> None:
        self.db.close()

    def _contract(self, tokens: np.ndarray, lens: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words one after another (tokens, and how many each has) after at most so many steps: their
        tokens, where each ends, and the steps that each took."""
        w = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int64)
        start = pa.table({"w": w, "p": p, "t": tokens})
        self.db.register("start", start)
        got = self.db.execute(_STEP, [steps]).fetchnumpy()
        self.db.unregister("start")
        ends = np.cumsum(np.bincount(np.asarray(got["w"]), minlength=len(lens)))
        return np.asarray(got["t"]).astype("<u4"), ends, np.asarray(got["k"])[ends - 1]

    def _settle(self, words) -> dict[bytes, bytes]:
        """Ids of each of the words, taken as they are."""
        out, group, rows = {}, [], 0
        for word in words:
            n = len(word)
            if group and rows + n * n // 2 > ROWS:
                out.update(self._settled(group, rows))
                group, rows = [], 0
            group.append(word)
            rows += n * n // 2
        if group:
            out.update(self._settled(group, rows))
        return out

    def _settled(self, group: list[bytes], rows: int):
        """Words with their ids. A word too long for one recursion goes on from where the last one left it."""
        tokens = self.single[np.frombuffer(b"".join(group), np.uint8)]
        lens = np.fromiter(map(len, group), np.int64, len(group))
        while True:
            steps = max(8, 2 * ROWS // len(tokens)) if rows > 2 * ROWS else 1 << 30
            ids, ends, took = self._contract(tokens, lens, steps)
            if not (took >= steps).any():
                break
            tokens, lens = ids.astype(np.int32), np.diff(ends, prepend=0)
            rows = int((lens * lens // 2).sum())
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        return zip(group, [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True)

    def _bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are cut into pieces: pieces first, then the borders that don't hold."""
        cut = [_pieces(w) for w in words]
        got = self._settle({p for pieces in cut for p in pieces})
        lines = [[got[p] for p in pieces] for pieces in cut]
        holds: dict[bytes, bool] = {}
        unsure, rounds = [k for k, line in enumerate(lines) if len(line) > 1], 0
        while unsure:
            pair = lambda line, j: line[j][-4:] + line[j + 1][:4]
            fresh = {pair(lines[k], j) for k in unsure for j in range(len(lines[k]) - 1)}.difference(holds)
            met = {p: self._bytes_of(p) for p in fresh}
            got = self._settle(set(met.values()))
            holds.update((p, got[b] == p) for p, b in met.items())
            plans, again, rounds = {}, [], rounds + 1
            for k in unsure:
                bad = [not holds[pair(lines[k], j)] for j in range(len(lines[k]) - 1)]
                if any(bad):
                    # Borders that move to and fro without end: the whole word in one.
                    plans[k] = self._mended(lines[k], bad) if rounds < 4 * len(cut[k]) + 16 else [(None, words[k])]
                    again.append(k)
            got = self._settle({data for plan in plans.values() for _, data in plan if data is not None})
            for k, plan in plans.items():
                lines[k] = [part if data is None else got[data] for part, data in plan]
            unsure = again
        return [b"".join(line) for line in lines]

    def _mended(self, line: list[bytes], bad: list[bool]):
        """What takes a line's place: parts that stay, and bytes to be encoded anew, which are the end of
        the part before a bad border and the part after it (its beginning, if it is long)."""
        plan = []
        for j, ids in enumerate(line):
            if j and bad[j - 1] and plan[-1][1] is None:
                stays, tail = self._split(plan.pop()[0], PIECE // 3, last=True)
                front, rest = (ids, b"") if len(self._bytes_of(ids)) <= 2 * PIECE else self._split(ids, PIECE // 2)
                if stays:
                    plan.append((stays, None))
                plan.append((None, self._bytes_of(tail + front)))
                if rest:
                    plan.append((rest, None))
            else:
                plan.append((ids, None))
        return plan

    def _split(self, ids: bytes, size: int, last: bool = False) -> tuple[bytes, bytes]:
        """Cuts off the first (or last) tokens that have at least so many bytes together."""
        step = -1 if last else 1
        sizes = np.cumsum([len(self.token[t]) for t in np.frombuffer(ids, "<u4")[::step].tolist()])
        at = 4 * min(int(np.searchsorted(sizes, size)) + 1, len(sizes))
        return (ids[:-at], ids[-at:]) if last else (ids[:at], ids[at:])

    def learn(self, words) -> None:
        """Encodes words that aren't known yet."""
        short, long, whole = {}, {}, {}
        for word in words:
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                whole[word] = rank.to_bytes(4, "little")
            else:
                (short if len(data) <= PIECE else long)[data] = word
        self._keep(whole)
        self._keep({short[data]: ids for data, ids in self._settle(short).items()})
        if long:
            self._keep(dict(zip(long.values(), self._joined(list(long)), strict=True)))

    def _keep(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.held += 200 * len(found) + 2 * sum(map(len, found)) + sum(map(len, found.values()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, waiting, held = [], [], 0
        for text in texts:
            waiting.append(self.find(text))
            held += len(text)
            if held >= 8_000_000:
                out += self._encode(waiting)
                waiting, held = [], 0
        return out + self._encode(waiting)

    def _encode(self, split: list[list[str]]) -> list[bytes]:
        if self.held > REMEMBER:
            self.before, self.known, self.held = self.known, {}, 0
        fresh = {w for words in split for w in words}.difference(self.known)
        again = fresh.intersection(self.before)
        self._keep({w: self.before[w] for w in again})
        self.learn(fresh - again)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out, group, held = [], [], 0
        for data in encoded:
            group.append(data)
            held += len(data) // 4
            if held >= IDS:
                out += self._decode(group)
                group, held = [], 0
        return out + self._decode(group)

    def _decode(self, group: list[bytes]) -> list[bytes]:
        out = [b""] * len(group)
        lens = np.fromiter((len(x) // 4 for x in group), np.int64, len(group))
        if lens.sum():
            ids = pa.table({"d": np.repeat(np.arange(len(group), dtype=np.int32), lens), "p": np.arange(lens.sum()),
                            "t": np.frombuffer(b"".join(group), "<u4").astype(np.int32)})
            self.db.register("ids", ids)
            for d, piece in self.db.execute(_DECODE).fetchall():
                out[d] = bytes.fromhex(piece)
            self.db.unregister("ids")
        return out


_kept: dict[str, Worker] = {}


def _worker(key: str, shared) -> Worker:
    """This process's worker for a broadcast vocabulary; it takes the place of another vocabulary's."""
    if key not in _kept:
        while _kept:
            _kept.popitem()[1].close()
        _kept[key] = Worker(shared.value)
    return _kept[key]


def _mapped(df: DataFrame, vocabulary: Vocabulary, source: str, added: list[tuple[str, pa.DataType, str]], work) -> DataFrame:
    """Adds columns computed from column `source` by work(worker, values) for each slice of rows."""
    shared, key = df.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key()
    columns = df.columns

    def run(batches):
        worker = _worker(key, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                new = work(worker, part.column(columns.index(source)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c, t) for c, (_, t, _) in zip(new, added, strict=True))], names=[*columns, *(n for n, _, _ in added)])
        pa.default_memory_pool().release_unused()  # else what the largest batch took stays with the process

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, own + "".join(f", {n} {s}" for n, _, s in added))


_IDS = ("ids", pa.binary(), "binary")
_BYTES = ("decoded", pa.binary(), "binary")


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with `ids` (binary, four bytes an id) in place of `text`."""
    d = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).drop("ids")
    return _mapped(d, vocabulary, "text", [_IDS], lambda w, texts: [w.encode(texts)]).drop("text")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds `decoded` (binary) to rows with `ids`."""
    return _mapped(encoded.drop("decoded"), vocabulary, "ids", [_BYTES], lambda w, ids: [w.decode([x or b"" for x in ids])])


def round_trip(docs: DataFrame, vocabulary: Vocabulary, order=()) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids, decoded: encoded, then decoded from the ids, by one worker.
    order: columns by which docs is sorted; they come along as `order`."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    *([F.struct(*(c.alias(f"by{i}") for i, c in enumerate(order))).alias("order")] if order else []))

    def work(worker, texts):
        ids = worker.encode(texts)
        return ids, worker.decode(ids)

    return _mapped(d, vocabulary, "text", [_IDS, _BYTES], work).drop("text")


def digests(docs: DataFrame, vocabulary: Vocabulary, order=()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; sorted by the columns order, if there are any."""
    out = round_trip(docs, vocabulary, order)
    shown = ["doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
             F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    if not order:
        return out.select(*shown)
    return out.select(*shown, "order").orderBy("order").drop("order")


@functools.cache
def multilingual() -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"), multilingual())
