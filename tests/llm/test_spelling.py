import random
import re
import zlib
from collections import Counter

from timeloom.llm import spelling

from .helpers import collect, docs


def slow_words(texts, ids):
    """By the definition, run by run."""
    out = Counter()
    for i, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def distance(u, v):
    row = list(range(len(v) + 1))
    for i, a in enumerate(u, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(v, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def slow_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v.encode())) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: {"word": w, "n": n[w], "n_near": len(near[w]), "form": form.get(w), "form_n": n.get(form.get(w)), "root": root(w)} for w in n}


def texts(seed=3, n=120):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÀß") for _ in range(r.randint(4, 9))) for _ in range(25)] + ["a" * 90, "x" * 40 + "y"]
    out = [None, "", " 12 ?! ", "kurz"]
    for _ in range(n):
        words = []
        for _ in range(60):
            w = r.choice(base[: r.randint(1, len(base))])
            kind, at = r.random(), r.randrange(len(w))
            if kind < 0.2:
                w = w[:at] + w[at + 1 :]
            elif kind < 0.4:
                w = w[:at] + r.choice("abcÉ") + w[at:]
            elif kind < 0.6:
                w = w[:at] + r.choice("abcÉ") + w[at + 1 :]
            words.append(w.upper() if r.random() < 0.05 else w)
        out.append(" ".join(words))
    return out


def test_like_brute_force_for_any_shard_size(spark):
    t = texts()
    d = docs(spark, t)
    want = slow_variants(slow_words(t, range(1, len(t) + 1)))
    assert len(want) > 300 and any(r["root"] != r["form"] and r["form"] for r in want.values())
    for node, asks in ((4096, 65536), (20, 15)):
        got = {r["word"]: r for r in collect(spelling.variants(d.withColumnRenamed("key", "word"), node, asks))}
        assert got == want


def test_crowded_bottom_of_the_trie_is_dealt_into_chunks(spark):
    # Anagrams share a vector; their neighbours lie one letter off.
    r = random.Random(1)
    anagrams = {"".join(r.sample("abcdefg", 7)) for _ in range(60)}
    words = sorted(anagrams | {w + "h" for w in list(anagrams)[:20]} | {w[1:] for w in list(anagrams)[:20]})
    t = [" ".join(words)] * 3
    n = {w: 3 for w in words}
    w = spark.createDataFrame([(x, 3, "".join(chr(48 + c) for c in spelling.vectors([x])[0])) for x in words], "word string, n long, vector string")
    got = {x["word"]: x["n_near"] for x in collect(spelling.neighbours(w, 8, 5))}
    want = {k: v["n_near"] for k, v in slow_variants(n).items() if v["n_near"]}
    assert got == want and t


def test_null_ids_repeats_and_an_empty_table(spark):
    t = ["alpha alpha alphb", "alpha alphb alphb"]
    d = spark.createDataFrame([(None, t[0], 1), (None, t[0], 1), (7, t[1], 1)], "doc_id long, text string, n long")
    want = slow_variants(slow_words([t[0], t[0], t[1]], [None, None, 7]))
    assert {r["word"]: r for r in collect(spelling.variants(d))} == want
    assert spelling.variants(d.limit(0)).count() == 0


def test_one_edit():
    r = random.Random(5)
    for _ in range(2000):
        u = "".join(r.choice("ab") for _ in range(r.randint(0, 6)))
        v = "".join(r.choice("ab") for _ in range(r.randint(0, 6)))
        assert spelling.one_edit(u, v) == (distance(u, v) == 1)
