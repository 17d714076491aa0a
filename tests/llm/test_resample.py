import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np

from timeloom.llm import resample

from .helpers import collect, corpus, docs


def words(text):
    return resample.flat(text).split(" ") if text else []


def features(text, orders):
    w = [x for x in words(text) if x]
    return [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]


def slow(rows, target, share, orders, buckets, least):
    of = lambda t: Counter(zlib.crc32(f.encode()) % buckets for f in features(t, orders))
    s, t = Counter(), Counter()
    for _, x in rows:
        s += of(x)
    for x in target:
        t += of(x)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, x in rows:
        h, n = of(x), len(features(x, orders))
        weight = sum(gain[b] * k for b, k in h.items()) // n if n else 0
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * share // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def run(spark, texts, target, **options):
    d = docs(spark, texts).withColumnRenamed("key", "score").withColumnRenamed("lang", "buckets")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    keep = ("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r[c] for c in keep) for r in collect(resample.resampled(d, t, **options))), key=str)


def test_like_brute_force_for_runs_of_several_words(spark):
    texts, target = corpus(40), [None, "", *corpus(6, seed=1)[-6:]]
    rows = list(enumerate(texts, 1))
    for orders, buckets, share in (((1, 1), 10_000, 10), ((1, 3), 97, 50), ((2, 2), 1000, 100)):
        assert run(spark, texts, target, orders=orders, buckets=buckets, share=share) == slow(rows, target, share, orders, buckets, 20)


def test_words_outside_the_dictionary_and_very_long_texts(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 60) for _ in range(k)) for k in (25, 30, 40_000)] + ["ÄÖ ü-9 x"] * 3
    rows = list(enumerate(texts, 1))
    for size in (3, 0):
        monkeypatch.setattr(resample.dictionary, "__defaults__", (size,))
        assert run(spark, texts, ["a b c"], share=70) == slow(rows, ["a b c"], 70, (1, 1), 10_000, 20)


def test_null_ids_repeats_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (3, text), (3, text + " x"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([], "text string")
    got = sorted((tuple(r.values()) for r in collect(resample.resampled(d, t, 100))), key=str)
    assert got == slow(rows, [], 100, (1, 1), 10_000, 20)
    assert resample.resampled(d.limit(0), t).count() == 0


def test_appended_crc():
    r = random.Random(1)
    pairs = [(r.randbytes(r.randint(0, 40)), r.randbytes(r.choice([0, 1, 7, 300, 70_000]))) for _ in range(100)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = resample.appended(a, b, np.array([len(y) for _, y in pairs]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]
