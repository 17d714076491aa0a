import numpy as np
import pytest
import xxhash

from tests.llm.helpers import collect, corpus, docs
from timeloom.llm import simhash as S
from timeloom.llm.graph import components


def plain_fingerprint(text):
    w = (text or "").encode().translate(S.LOWER).split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=4):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_matches_brute_force(spark):
    texts = corpus(80)
    got = {r["doc_id"]: r for r in collect(S.near_duplicates(docs(spark, texts)))}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(list(range(1, len(texts) + 1)), fps)
    for i, (f, c) in enumerate(zip(fps, want), 1):
        assert got[i]["fp"] & (2**64 - 1) == f and got[i]["component_id"] == c


def test_links_of_dense_fingerprints_in_small_blocks(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 4)
    fps = {int(b) ^ sum(1 << int(x) for x in r.choice(63, r.integers(0, 7), replace=False)) for b in base for _ in range(120)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in collect(components(S.links(df, block=16)))}
    want = plain_components(fps, fps)
    assert [got.get(f, f) for f in fps] == want


def test_edges_cases(spark):
    empty = docs(spark, [])
    assert collect(S.near_duplicates(empty)) == []
    assert S.keep_one(empty).columns == empty.columns
    twice = docs(spark, ["a b c d e"]).union(docs(spark, ["a b c d e"]))
    assert len(collect(S.keep_one(twice))) == 1
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), radius=6)


def test_keep_one(spark):
    texts = corpus(40)
    d = docs(spark, texts)
    want = {r["component_id"] for r in collect(S.near_duplicates(d))}
    got = collect(S.keep_one(d))
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)


def test_keep_one_with_null_and_repeated_ids(spark):
    texts = [t for t in corpus(40) if t and len(t.split()) > 30]
    fps = [plain_fingerprint(t) for t in texts]
    ids = [[None, 7, None, 8, 100 + i][i % 5] for i in range(len(texts))]
    groups = plain_components(list(range(len(texts))), fps)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, key string").repartition(3)
    got = collect(S.keep_one(df))
    member = {t: g for t, g in zip(texts, groups)}
    assert sorted(member[r["text"]] for r in got) == sorted(set(groups))
    for r in got:
        mine = [i for i, g in zip(ids, groups) if g == member[r["text"]]]
        assert r["doc_id"] == min((i for i in mine if i is not None), default=None)
        assert (r["doc_id"], r["text"]) in set(zip(ids, texts)) and r["key"] == "x"
    assert sum(r["doc_id"] is None for r in got) > 5 and sum(r["doc_id"] == 7 for r in got) > 2
