import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import collect, corpus, docs
from timeloom.llm import repeats, substrings, suffixes


def plain(texts, length, across, tokens, join):
    """Brute force: id i+1 for texts[i]."""
    seen, out = {}, []
    toks = [tokens(t or "") for t in texts]
    for i, t in enumerate(toks):
        for p in range(len(t) - length + 1):
            seen.setdefault(tuple(t[p : p + length]), (i, p))
    for i, t in enumerate(toks):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            f = seen[tuple(t[p : p + length])]
            if (f[0] < i) if across else f < (i, p):
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, join(x for x, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    texts = corpus(50, seed, vocabulary=[400, 3][seed - 1])
    want = plain(texts, 13, True, lambda t: t.encode().split(), b" ".join)
    got = {r["doc_id"]: r for r in collect(substrings.remove_repeated_words(docs(spark, texts)))}
    for i, (n, gone, spans, kept) in enumerate(want, 1):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["n_spans"], r["text"].encode()) == (n, gone, spans, kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes(spark, seed):
    r = random.Random(seed)
    texts = corpus(25, seed, vocabulary=[300, 4, 60][seed - 1])
    texts += ["a" * 350, "xyz" * 90, "a" * 99, "b" * 100, "b" * 100, texts[7][:150] + "Q" + texts[7][150:]]
    r.shuffle(texts)
    want = plain(texts, 100, False, lambda t: t.encode(), bytes)
    got = {x["doc_id"]: x for x in collect(suffixes.remove_repeated_bytes(docs(spark, texts)))}
    for i, (n, gone, spans, kept) in enumerate(want, 1):
        x = got[i]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) == (n, gone, spans, kept)


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_PART", 20)
    texts = corpus(30, 4, vocabulary=3) + [" ".join("ab"[k % 7 % 2] for k in range(400))] * 2
    want = plain(texts, 13, True, lambda t: t.encode().split(), b" ".join)
    got = {r["doc_id"]: r for r in collect(substrings.remove_repeated_words(docs(spark, texts).coalesce(2)))}
    assert [(got[i]["n_removed"], got[i]["text"].encode()) for i in range(1, len(texts) + 1)] == [(w[1], w[3]) for w in want]


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 150)
    texts = corpus(12, 5)
    doc = docs(spark, texts).coalesce(1)
    want = plain(texts, 100, False, lambda t: t.encode(), bytes)
    got = {x["doc_id"]: x for x in collect(suffixes.remove_repeated_bytes(doc))}
    assert [(got[i]["n_removed"], bytes(got[i]["kept"])) for i in range(1, len(texts) + 1)] == [(w[1], w[3]) for w in want]


def test_null_ids_are_documents_of_their_own(spark):
    r = random.Random(3)
    shared = "".join(r.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(r.choice("ijklmno ") for _ in range(r.randint(120, 200))) + shared for _ in range(60)]
    d = docs(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))
    got = collect(suffixes.remove_repeated_bytes(d.union(docs(spark, [shared]))))
    gone = sorted(x["n_removed"] for x in got)  # one text without an id comes first and keeps it
    assert gone[0] == 0 and all(150 <= n < 155 for n in gone[1:])  # letters before it may agree by chance


def test_edge_cases(spark):
    assert collect(substrings.remove_repeated_words(docs(spark, []))) == []
    twice = docs(spark, ["w " * 20]).union(docs(spark, ["w " * 20]))
    got = collect(substrings.remove_repeated_words(twice))
    assert [r["n_removed"] for r in got] == [0, 0]
    nulls = twice.selectExpr("cast(null as bigint) as doc_id", "text").union(docs(spark, ["w " * 20]).select("doc_id", "text"))
    assert sorted(r["n_removed"] for r in collect(substrings.remove_repeated_words(nulls))) == [0, 0, 20]
    other = nulls.union(nulls.selectExpr("doc_id", "'v w x y z ' || text"))  # null ids with different texts
    assert sorted(r["n_removed"] for r in collect(substrings.remove_repeated_words(other))) == [0, 0, 0, 0, 20, 25]
    named = docs(spark, ["w " * 20, None, ""]).selectExpr("*", "1 AS id", "2 AS mark", "3 AS at", "4 AS n_words")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in collect(substrings.remove_repeated_words(named))) == [(1, 20, 0), (2, 0, 0), (3, 0, 0)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in collect(suffixes.remove_repeated_bytes(named))) == [(1, 40, 0), (2, 0, 0), (3, 0, 0)]
