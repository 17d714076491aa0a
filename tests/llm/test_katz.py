import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import collect, corpus, docs
from timeloom.llm import katz


def low(t):
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t)


class Plain:
    """Brute force over lists of tokens."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            prev = None
            for w in [*low(t).encode().split(), 0]:
                self.uni[w] += 1
                self.bi[prev][w] += 1
                prev = w
        self.total = sum(self.uni.values())
        self.d1 = katz.discounts(Counter(self.uni.values()))
        self.d2 = katz.discounts(Counter(n for f in self.bi.values() for n in f.values()))

    def cut(self, c, d):
        return c * d[c - 1] if c <= katz.K else c - katz.TAIL

    def p1(self, w):
        if w in self.uni:
            return self.cut(self.uni[w], self.d1) / self.total
        return 1 - sum(self.cut(c, self.d1) for c in self.uni.values()) / self.total

    def p(self, w, v):
        seen = self.bi.get(v)
        if seen is None:
            return self.p1(w)
        n = sum(seen.values())
        if w in seen:
            return self.cut(seen[w], self.d2) / n
        left = 1 - sum(self.cut(c, self.d2) for c in seen.values()) / n
        return left / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, t):
        prev, s = None, 0.0
        for w in [*low(t).encode().split(), 0]:
            s += math.log10(self.p(w, prev))
            prev = w
        return s

    def base(self, t):
        return sum(math.log10((self.uni[w] + 0.1) / (self.total + 0.1 * (len(self.uni) + 1))) for w in [*low(t).encode().split(), 0])


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(katz, "CHUNK", 300)
        monkeypatch.setattr(katz, "BUCKET", 200)
        monkeypatch.setattr(katz, "HEAVY", 60)
    texts = [t if t is None else t.replace("a", "A", 3) for t in corpus(60, vocabulary=[300, 40][small])]
    d = docs(spark, texts).select("doc_id", (F.col("doc_id") % 4 == 0).alias("out"), F.coalesce("text", F.lit("")).alias("text"))
    got = {r["doc_id"]: r for r in collect(katz.score(d))}
    plain = Plain([t or "" for i, t in enumerate(texts, 1) if i % 4])
    for i, t in enumerate(texts, 1):
        words = [*low(t or "").encode().split(), 0]
        assert got[i]["n_tokens"] == len(words) and got[i]["train_tokens"] == plain.total
        assert got[i]["n_known"] == sum(w in plain.uni for w in words)
        assert got[i]["base_score"] == pytest.approx(plain.base(t or ""), rel=1e-9)
        assert got[i]["score"] == pytest.approx(plain.score(t or ""), rel=1e-9)


def test_hot_pairs_leave_no_postings(spark, monkeypatch):
    monkeypatch.setattr(katz, "HEAVY", 40)
    texts = [f"very common pair w{i % 7} x{i}" for i in range(80)] + ["", "very common", "common very pair"]
    d = docs(spark, texts).repartition(5).select("doc_id", (F.col("doc_id") % 4 == 0).alias("out"), "text")
    plain = Plain([t for i, t in enumerate(texts, 1) if i % 4])
    filed, postings, evaluate = [], katz._postings, katz._terms

    def spy(docs, buckets, part, heavy, hot, terms):
        filed.append((len(hot[0]), terms is not None))
        return postings(docs, buckets, part, heavy, hot, terms)

    monkeypatch.setattr(katz, "_postings", spy)
    counts = []
    monkeypatch.setattr(katz, "_terms", lambda uni, c, *rest: counts.append(sorted(c.tolist())) or evaluate(uni, c, *rest))
    got = {r["doc_id"]: r["score"] for r in collect(katz.score(d))}
    for i, t in enumerate(texts, 1):
        assert got[i] == pytest.approx(plain.score(t), rel=1e-9)
    often = sorted(n for f in plain.bi.values() for n in f.values() if n * 40 >= plain.total)
    assert filed == [(len(often), False), (len(often), True)] and len(often) >= 3
    assert counts[-1] == often


def test_distributions_add_up():
    plain = Plain([t or "" for t in corpus(30)])
    for v in [None, *list(plain.bi)[:20]]:
        assert sum(plain.p(w, v) for w in [*plain.uni, b"never seen"]) == pytest.approx(1)


def test_edges(spark):
    schema = "doc_id long, out boolean, text string"
    assert collect(katz.score(spark.createDataFrame([], schema))) == []
    all_out = collect(katz.score(spark.createDataFrame([(1, True, "a b"), (2, True, "")], schema)))
    assert [(r["score"], r["train_tokens"]) for r in all_out] == [(0.0, 0), (0.0, 0)]
    rows = [(1, False, "a b a"), (1, False, "a b a"), (None, False, "a c"), (2, True, "a d")]
    got = collect(katz.score(spark.createDataFrame(rows, schema)))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 4), (1, 4), (2, 3)]
    plain = Plain(["a b a", "a b a", "a c"])
    for r in got:
        t = {1: "a b a", None: "a c", 2: "a d"}[r["doc_id"]]
        assert r["score"] == pytest.approx(plain.score(t))
