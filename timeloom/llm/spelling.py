"""Spelling variants: words one edit apart, found by a trie over letter counts.

A word's vector counts its letters, group by group (frequent letters are groups of their own). Arranged by
successive counts, the vectors of all words form a trie. Inserting a letter raises one count by one,
deleting lowers one, replacing does both: whatever is one edit away lies within a surplus of one and a
deficit of one. A depth-first search walks the trie, a node's queries together: each spends its surplus or its
deficit where a child's count differs from its own, and drops out where it can't. Words in the leaves that
it reaches are compared with it letter by letter.

The trie is cut into shards: the nodes nearest the root with NODE words at most (with a 2,048th of all words,
where that is more, so that the list of shards, which every task gets, is bounded). Each word's row goes to its
shard, and asks in all shards within its budget. The asks of a crowded shard are dealt into parts, which get a
copy of the shard's words each. A node that stays crowded at the trie's bottom (anagrams) is dealt into chunks,
and its asks go to all of them. Each pair meets once: a word asks for words as long or one longer.

Words count as one edit apart if they differ by exactly one inserted, deleted or replaced code point.

Cases: a null or empty text has no runs; null ids count as the empty text in the hash of a run; repeated
rows count again; runs of any length are words; very long texts are split into runs as a whole, in one row; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, load, scratch

LEAST_LENGTH, LEAST_COUNT, SLIP, LEAD = 5, 3, 97, 2
#: Words in a shard, asks in a part of one.
NODE, ASKS = 4_096, 65_536
#: The trie's levels: letters from the most frequent, then other code points in six classes.
LETTERS = "etaoinshrdlucmfwygpbvkxjqz"
CLASSES = 6
LEVELS = len(LETTERS) + CLASSES
#: Counts are kept as characters from "0" on; higher ones count as this, which loses no neighbour.
_MOST = 70
#: Words that a trie's leaf holds; distinct runs that a task counts before it passes them on.
_LEAF, _HELD = 16, 500_000
#: Words longer than this are compared one by one.
_WIDE = 32
_RUN = re.compile("[a-zÀ-ÿ]+")
_LEVEL_OF = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % CLASSES for c in range(256)])


def words_of(doc_id, text: str | None) -> Counter:
    """The runs of a text after their slips, with their counts."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall((text or "").encode().translate(LOWER).decode())).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def vectors(words: list[str]) -> np.ndarray:
    """A row of counts (int8) for each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    counts = np.bincount(owner * LEVELS + _LEVEL_OF[codes], minlength=len(words) * LEVELS)
    return np.minimum(counts, _MOST).astype(np.int8).reshape(len(words), LEVELS)


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n, vector (a character a level) of the words that are long and frequent enough."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update(words_of(doc_id, text))
                if len(found) >= _HELD:
                    yield _counts(found)
                    found = Counter()
        if found:
            yield _counts(found)

    def _counts(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def shapes(batches):
        for batch in batches:
            if batch.num_rows:
                rows = (vectors(batch.column(0).to_pylist()) + 48).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes().decode() for r in rows], pa.string())], names=["word", "n", "vector"])

    every = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    often = every.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return often.mapInArrow(shapes, "word string, n long, vector string")


def shards(words: DataFrame, node: int = NODE) -> list[tuple[str, int]]:
    """The nodes that tasks take over: (counts on the way to it, its words)."""
    total = words.count()
    node = max(node, -(-total // 2048))
    ready, crowded = ([("", total)], []) if total <= node else ([], [""])
    for depth in range(1, LEVELS + 1):
        if not crowded:
            break
        inside = words.where(F.substring("vector", 1, depth - 1).isin(crowded)) if depth > 1 else words
        found = inside.groupBy(F.substring("vector", 1, depth).alias("at")).count().collect()  # at most 2,048 x 71 rows, by node's size
        crowded = [r["at"] for r in found if r["count"] > node and depth < LEVELS]
        ready += [(r["at"], r["count"]) for r in found if r["count"] <= node or depth == LEVELS]
    return sorted(ready)


class Routes:
    """The top of the trie, down to the shards."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for i, name in enumerate(names):
            at = self.root
            for c in name[:-1]:
                at = at.setdefault(ord(c) - 48, {})
            if name:
                at[ord(name[-1]) - 48] = i
            else:
                self.root = i

    def asks(self, q: np.ndarray):
        """(shard, rows of q, surplus left, deficit left) for all shards within the rows' budgets."""
        n = len(q)
        stack = [(self.root, 0, np.arange(n), np.ones(n, bool), np.ones(n, bool))]
        while stack:
            node, level, rows, more, less = stack.pop()
            if not isinstance(node, dict):
                yield node, rows, more, less
                continue
            for c, child in node.items():
                kept = _spent(c, q[rows, level], more, less)
                if len(kept[0]):
                    stack.append((child, level + 1, rows[kept[0]], *kept[1:]))


def _spent(count: int, own: np.ndarray, more: np.ndarray, less: np.ndarray):
    """Which queries go on to a child of this count, and what they have left."""
    diff = count - own
    kept = np.flatnonzero((diff == 0) | ((diff == 1) & more) | ((diff == -1) & less))
    diff = diff[kept]
    return kept, more[kept] & (diff != 1), less[kept] & (diff != -1)


def leaf_pairs(v: np.ndarray, q: np.ndarray, more: np.ndarray, less: np.ndarray, level: int):
    """Depth-first search below a shard. v: the shard's vectors in order; q: its queries'. Yields index
    arrays (words, queries) of the pairs within budget."""
    stack = [(0, len(v), level, np.arange(len(q)), more, less)]
    while stack:
        lo, hi, level, rows, more, less = stack.pop()
        if hi - lo <= _LEAF or level == LEVELS:
            step = max(1, 4_000_000 // ((hi - lo) * max(LEVELS - level, 1)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                diff = v[lo:hi, None, level:] - q[part][None, :, level:]
                fits = (np.maximum(diff, 0).sum(2) <= more[a : a + step]) & (np.maximum(-diff, 0).sum(2) <= less[a : a + step])
                i, j = np.nonzero(fits)
                if len(i):
                    yield lo + i, part[j]
            continue
        column = v[lo:hi, level]
        counts, at = np.unique(column, return_index=True)
        for c, a, b in zip(counts, at, [*at[1:], hi - lo], strict=True):
            kept = _spent(c, q[rows, level], more, less)
            if len(kept[0]):
                stack.append((lo + int(a), lo + int(b), level + 1, rows[kept[0]], *kept[1:]))


def one_edit(u: str, v: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    at = next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(u))
    return u[at + (len(u) == len(v)) :] == v[at + 1 :]


class _Letters:
    """Words as rows of codes, from their first letter on and from their last one back."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, np.fromiter(map(len, words), np.int64, len(words))
        self.ahead = np.zeros((len(words), _WIDE), np.uint8)
        self.back = np.zeros((len(words), _WIDE), np.uint8)
        for i, w in enumerate(words):
            if len(w) <= _WIDE:
                raw = np.frombuffer(w.encode("latin-1"), np.uint8)
                self.ahead[i, : len(raw)], self.back[i, : len(raw)] = raw, raw[::-1]


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that agree before the first that doesn't."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), _WIDE)


def verified(own: _Letters, i: np.ndarray, asks: _Letters, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (own[i], asks[j]) are one edit apart; own[i] is as long or one longer."""
    n, m = own.length[i], asks.length[j]
    head, tail = _same(own.ahead[i], asks.ahead[j]), _same(own.back[i], asks.back[j])
    ok = (n - m >= 0) & (n - m <= 1) & (np.minimum(head, m) + np.minimum(tail, m) >= np.where(n == m, m - 1, m)) & ((n != m) | (head < m))
    for k in np.flatnonzero(np.maximum(n, m) > _WIDE):
        ok[k] = n[k] >= m[k] and one_edit(own.words[i[k]], asks.words[j[k]])
    return ok


_ROWS = "shard int, part int, asks boolean, word string, n long, more boolean, less boolean"
_LINKS = "word string, n_near long, near string, near_n long"


def _batch(shard, part, asks, word, n, more, less):
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((shard, part, asks, word, n, more, less), types, strict=True)],
                                      names=["shard", "part", "asks", "word", "n", "more", "less"])


def _asked(words: DataFrame, names: list[str]) -> DataFrame:
    """How many words ask in each shard: shard, n."""

    def run(batches):
        routes, total = Routes(names), np.zeros(len(names), np.int64)
        for batch in batches:
            q = _read(batch.column(2))
            for shard, rows, _, _ in routes.asks(q):
                total[shard] += len(rows)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["shard", "n"])

    return words.mapInArrow(run, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))


def _read(column) -> np.ndarray:
    return (np.frombuffer("".join(column.to_pylist()).encode(), np.int8) - 48).reshape(-1, LEVELS)


def _dealt(words: DataFrame, names: list[str], chunks: list[int], parts: list[int]) -> DataFrame:
    """Words in their shards, and asks in those within budget. A shard's places are chunk x parts + part."""

    def run(batches):
        routes, place = Routes(names), {name: i for i, name in enumerate(names)}
        depths = sorted({len(n) for n in names})
        for batch in batches:
            word, n, shape = (c.to_pylist() for c in batch.columns)
            q, h = _read(batch.column(2)), [zlib.crc32(w.encode()) for w in word]
            own = [next(place[v[:d]] for d in depths if v[:d] in place) for v in shape]
            rows = [(s, h[i] // 65537 % chunks[s] * parts[s] + p, i) for i, s in enumerate(own) for p in range(parts[s])]
            if rows:
                s, p, i = zip(*rows)
                k = len(rows)
                yield _batch(s, p, [False] * k, [word[x] for x in i], [n[x] for x in i], [False] * k, [False] * k)
            for s, at, more, less in routes.asks(q):
                for c in range(chunks[s]):
                    yield _batch([s] * len(at), [c * parts[s] + h[x] % parts[s] for x in at], [True] * len(at), [word[x] for x in at], [n[x] for x in at], more, less)

    return words.mapInArrow(run, _ROWS)


def _linked(depths: list[int]):
    """A group's links: each word with how many it found there and the most frequent of them."""

    def run(table):
        own, asks = table.filter(pc.invert(table["asks"])), table.filter(table["asks"])
        empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        if not own.num_rows or not asks.num_rows:
            return empty
        words = own["word"].to_pylist()
        v = vectors(words)
        order = np.lexsort(v.T[::-1])
        v, words, count = v[order], [words[i] for i in order], own["n"].to_numpy()[order]
        others, other_n = asks["word"].to_pylist(), asks["n"].to_numpy()
        a, b = _Letters(words), _Letters(others)
        found_i, found_j = [], []
        level = depths[own["shard"][0].as_py()]
        for i, j in leaf_pairs(v, vectors(others), asks["more"].to_numpy(False), asks["less"].to_numpy(False), level):
            ok = verified(a, i, b, j)
            found_i.append(i[ok])
            found_j.append(j[ok])
        if not found_i:
            return empty
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        once = np.array([len(words[x]) != len(others[y]) or others[y] < words[x] for x, y in zip(i, j, strict=True)], bool)
        i, j = i[once], j[once]
        out: dict[str, list] = {}
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            for w, o, k in ((words[x], others[y], int(other_n[y])), (others[y], words[x], int(count[x]))):
                held = out.setdefault(w, [0, o, k])
                held[0] += 1
                if (-k, o) < (-held[2], held[1]):
                    held[1:] = o, k
        return pa.table({"word": pa.array(out, pa.string()), "n_near": pa.array([h[0] for h in out.values()], pa.int64()),
                         "near": pa.array([h[1] for h in out.values()], pa.string()), "near_n": pa.array([h[2] for h in out.values()], pa.int64())})

    return run


def neighbours(words: DataFrame, node: int = NODE, asks: int = ASKS) -> DataFrame:
    """words (word, n, vector) to word, n_near, near (most frequent, then least) and near_n, where there are any."""
    found = shards(words, node)
    names = [name for name, _ in found]
    limit = max(node, max((n for name, n in found if len(name) < LEVELS), default=0))
    chunks = [-(-n // limit) for _, n in found]
    asked = {r["shard"]: r["n"] for r in _asked(words, names).collect()}  # a row a shard
    parts = [-(-asked.get(i, 1) // asks) for i in range(len(names))]
    rows = _dealt(words, names, chunks, parts)
    links = rows.groupBy("shard", "part").applyInArrow(_linked([len(n) for n in names]), _LINKS)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) to word, root: the last that its forms lead to. Pointers double each round; a form is
    twice as frequent as its word at least, so six rounds suffice for any counts."""
    ways = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not ways.where("moved").isEmpty():
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ways = cut(ways.join(on, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
    return ways.select("word", "root")


def variants(docs: DataFrame, node: int = NODE, asks: int = ASKS) -> DataFrame:
    """docs (doc_id, text) to word, n, n_near, form, form_n, root."""
    with scratch(docs.sparkSession) as kept:
        words = cut(counted_words(docs), "words")
        near = cut(neighbours(words, node, asks), "near")
        d = words.select("word", "n").join(near, "word", "left")
        taken = F.col("near_n") >= LEAD * F.col("n")
        d = d.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n"))
        d = cut(d, "forms")
        ends = roots(d.where("form is not null"))
        out = cut(d.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
        kept.append(out)
    return out


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
                    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
c AS (SELECT w, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r WHERE length(w) >= 5 GROUP BY doc_id, w),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
                    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM c, tbl),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
n AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, n.word, n.n FROM d JOIN n ON d.part = n.word UNION SELECT n.word, d.word, d.n FROM d JOIN n ON d.part = n.word),
b AS (SELECT word, count(*) AS n_near, min({'a': -near_n, 'b': near}) AS best FROM p GROUP BY word),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 2 * n THEN best.b END AS form, CASE WHEN -best.a >= 2 * n THEN -best.a END AS form_n
      FROM n LEFT JOIN b USING (word)),
w AS (SELECT word, word AS tip, 0 AS steps FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM w JOIN f ON f.word = w.tip WHERE f.form IS NOT NULL)
SELECT f.word, n::BIGINT AS n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, root
FROM f JOIN (SELECT word, arg_max(tip, steps) AS root FROM w GROUP BY word) USING (word)
"""
