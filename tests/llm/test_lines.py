import random

import xxhash

from tests.llm.helpers import collect, docs
from timeloom.llm import lines


def some_texts(seed=3):
    r = random.Random(seed)
    pool = [f"line {r.randrange(10**6)} é" for _ in range(60)] + ["", "  ", "x"]
    shared = ["\n".join(r.choice(pool) for _ in range(12)) for _ in range(3)]
    out = [None, "", "\n", "\n\n\n\n", "one line"]
    for _ in range(40):
        t = "\n".join(r.choice(pool) for _ in range(r.randint(1, 20)))
        if r.random() < 0.5:
            t += "\n" + r.choice(shared) + "\n" + r.choice(pool)
        out += [t] * r.choice([1, 1, 2])
    return out


def chunks(rows):
    """Starts and ends by the definition: bits of a polynomial over the hashes of two lines."""
    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in rows]
    h = [mixed(a + b * BASE) for a, b in zip(h, h[1:])]
    for start, x in enumerate(h):
        if (x >> 8) % 8:
            yield start, next((end + 2 for end in range(start, len(h)) if (h[end] >> 36) % 8), len(rows))


BASE = 0x9E3779B97F4A7C15


def mixed(h):
    h %= 2**64
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 32


def plain(texts):
    """Chunks seen before, and up to four lines on both sides, one by one."""
    split = [(t or "").split("\n") for t in texts]
    first, out = {}, []
    for d, rows in enumerate(split):
        gone, n = set(), 0
        for lo, hi in chunks(rows):
            body = "\n".join(rows[lo:hi])
            if not body.split():
                continue
            e, start = first.setdefault(body, (d, lo))
            if (e, start) == (d, lo):
                continue
            n += 1
            gone |= {*range(lo, hi)}
            other, end = split[e], start + hi - lo
            step = 1
            while step <= 4 and lo - step >= 0 and start - step >= 0 and rows[lo - step] == other[start - step]:
                gone.add(lo - step)
                step += 1
            step = 0
            while step < 4 and hi + step < len(rows) and end + step < len(other) and rows[hi + step] == other[end + step]:
                gone.add(hi + step)
                step += 1
        out.append((n, "\n".join(x for i, x in enumerate(rows) if i not in gone) if gone else texts[d]))
    return out


def test_matches_brute_force_and_keeps_columns(spark):
    texts = some_texts()
    d = docs(spark, texts)
    want = plain(texts)
    got = {r["doc_id"]: r for r in collect(lines.removals(d))}
    assert sum(w[0] for w in want) > 10
    for i, w in enumerate(want, 1):
        assert (got[i]["n_chunks"], got[i]["text"]) == w
    whole = {r["doc_id"]: r for r in collect(lines.dedup_lines(d))}
    assert lines.dedup_lines(d).columns == d.columns
    for i, w in enumerate(want, 1):
        assert whole[i]["text"] == w[1] and whole[i]["key"] == "x"
        assert whole[i]["n_chars"] == len(w[1] or "")


def test_boundaries_resist_shifts():
    body = "\n".join(f"row {i}" for i in range(60)).encode()
    a = {c[2] for c in lines.chunks_of(body)}
    b = {c[2] for c in lines.chunks_of(b"a new line\nand one more\nthird\n" + body)}
    assert len(a & b) >= len(a) - 3


def test_edges(spark):
    assert collect(lines.removals(docs(spark, []))) == []
    one = docs(spark, ["a b\nc d\ne f\ng h"])
    assert [r["n_removed"] for r in collect(lines.removals(one.union(one)))] == [0, 0]


def test_nothing_is_lost_and_passages_go(spark):
    """Every line that goes is at an earlier place that stays; of passages, more lines go the longer they are."""
    r = random.Random(5)
    own = lambda k: [f"own {r.randrange(10**9)} é" for _ in range(k)]
    texts, passages = [], []
    for n in (2, 3, 5, 8):
        for _ in range(25):
            p = own(n)
            passages.append(p)
            texts += ["\n".join(own(r.randint(0, 5)) + p + own(r.randint(0, 5))) for _ in range(3)]
    texts += ["a\na\na\na\na", "x\n\ny\nz", "q\nx\n\ny", texts[-1]]
    got = {row["doc_id"]: row for row in collect(lines.removals(docs(spark, texts)))}
    for i, t in enumerate(texts, 1):
        n = t.count("\n") + 1
        assert got[i]["n_lines"] == n and (got[i]["text"] == "" or got[i]["n_removed"] == n - got[i]["text"].count("\n") - 1)
    left = [x for row in got.values() for x in row["text"].split("\n")]
    assert {x for t in texts for x in t.split("\n")} == {*left}
    gone = {n: sum(all(left.count(x) == 1 for x in p) for p in passages if len(p) == n) for n in (2, 3, 5, 8)}
    assert gone[8] == gone[5] == 25 and gone[3] >= 20 and 13 <= gone[2] < 25


def test_rows_come_from_chunks(spark, monkeypatch):
    d = docs(spark, some_texts())
    assert sum(r["n_removed"] for r in collect(lines.removals(d))) > 0
    every = lines._chunks
    monkeypatch.setattr(lines, "_chunks", lambda keyed: every(keyed).limit(0))
    assert sum(r["n_removed"] for r in collect(lines.removals(d))) == 0


def test_bytes_decide(spark, monkeypatch):
    """Chunks and lines whose hashes agree stay if their bytes differ."""
    class Blind:
        xxh3_64_intdigest = staticmethod(lambda b: 7 if b.startswith(b"same") else xxhash.xxh3_64_intdigest(b))
        xxh3_128_digest = staticmethod(lambda b: xxhash.xxh3_128_digest(b"" if b.startswith(b"same") else b))

    d = docs(spark, ["same 1\nsame 2\nsame 3\nsame 4", "same 5\nsame 6\nsame 7\nsame 8", "a\nb\nc\nd\ne", "a\nb\nc\nd\ne"])
    monkeypatch.setattr(lines, "xxhash", Blind)
    assert [r["n_removed"] for r in sorted(collect(lines.removals(d)), key=lambda r: r["doc_id"])][:2] == [0, 0]


def test_null_ids_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"row {i % 5000} é" for i in range(20_000))
    rows = [(None, "a b\nc d\ne f\ng h\ni j", 1, "q", "r"), (None, "a b\nc d\ne f\ng h\ni j", 1, "q", "r"), (4, long, 1, "q", "r"), (5, long, 1, "q", "r"), (6, "a b\nc d\ne f\ng h\ni j", 1, "q", "r")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row long, gone string, lines string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in collect(lines.removals(d))))
    assert got[:2] == [(0, 0), (0, 0)] and got[4] == (6, 5) and got[3] == (5, 20_000) and 14_000 <= got[2][1] <= 15_000
    out = lines.dedup_lines(d)
    assert out.columns == d.columns and {(r["row"], r["gone"], r["lines"]) for r in collect(out)} == {(1, "q", "r")}
