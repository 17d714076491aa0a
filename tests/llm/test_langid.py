import math
import random
import zlib

import regex

from tests.llm.helpers import collect, docs
from timeloom.llm import langid as L

SF = "/root/testdata/sf0.01"


def plain_phrases(fit, text):
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in fit:
            k += 1
        n, at = n + 1, at + max(k, 1)
    return n


def test_phrases_match_brute_force(monkeypatch):
    fit = {"x": "abracadabra abba", "y": "hocus pocus locus"}
    m = L.Model(fit)
    texts = ["abra pocus", "zzz", "a", "cadabra hocus abba focus", "qaq"]
    got = m.phrases(texts)
    for t, row in zip(texts, got):
        assert row.tolist() == [plain_phrases(fit[lang], t) for lang in m.langs]
    r = random.Random(3)
    texts += ["".join(r.choice("abrcdhopusl z") for _ in range(r.randint(1, 300))) for _ in range(40)]
    texts += ["abracadabra abba" * 9, "hocus pocus locusabra" * 7, "abrac" * 30, "z" * 50]
    for segment in (1, 2, 3, 5, 8, 64):  # pieces never change the parse of the whole
        monkeypatch.setattr(L, "SEGMENT", segment)
        for t, row in zip(texts, m.phrases(texts)):
            assert row.tolist() == [plain_phrases(fit[lang], t) for lang in m.langs]


def test_predictions_match_brute_force(spark):
    """The whole query's verdicts from brute-force parses of whole texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    d = spark.createDataFrame(rows.collect(), rows.schema)
    fit = {"a": "lorem ipsum dolor sit amet " * 20, "b": "der die das und nicht mit " * 3, "c": "le la les et que pas " * 40}
    got = {r["doc_id"]: r for r in collect(L.identify(d, fit))}
    for r in d.collect():
        text = (r["text"] or "").lower()[:1500]
        if len(text) < 1500 and regex.search(r"\p{L}", text):
            cost = {k: plain_phrases(f, text) * math.log2(len(f) + 1) for k, f in fit.items()}
            assert got[r["doc_id"]]["lang_pred"] == min(sorted(cost), key=cost.get)


def test_letters_ties_and_clashing_columns(spark):
    d = docs(spark, ["½ ² ¼", "٣ 4", "", None, "ab", "漢"]).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS cost", "4 AS row")
    d = d.union(d.where("doc_id = 5").selectExpr("CAST(NULL AS BIGINT)", *d.columns[1:]))
    out = L.predict(d, L.Model({"x": "abab", "w": "abab"}))
    assert sorted(out.columns) == sorted([*(c for c in d.columns if c != "text")])
    got = collect(out)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {"und"} and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert {r["lang_pred"] for r in got if r["doc_id"] in (5, None)} == {"w"}  # equal costs: first by code point


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in collect(L.op8_cross_parsing(spark, SF))}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in rows)
    good = sum(rows[i]["lang_pred"] == truth[i] for i in held)
    print("held-out accuracy", good / len(held))
    assert good >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_edges(spark):
    d = docs(spark, [None, "", "12 34 !?", "abc abc", "été"])
    m = L.Model(L.fit_texts(d.select("doc_id", "text", "lang")))
    got = {r["doc_id"]: r for r in collect(L.predict(d.drop("lang"), m))}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[5]["key"] == "x" and got[4]["lang_pred"] in m.langs
    nothing = L.Model({})
    assert {r["lang_pred"] for r in collect(L.predict(d, nothing))} == {"und"}
    assert collect(L.predict(docs(spark, []), m)) == []


def test_automaton_knows_all_substrings():
    text = "aabbabab"
    go = L.suffix_automaton(text)

    def known(s):
        state = 0
        for c in s:
            if c not in go[state]:
                return False
            state = go[state][c]
        return True

    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            assert known(text[a:b])
    assert not known("bbb") and not known("aaa")


SCRIPTS = {
    "ar": "".join(chr(0x621 + i * 7 % 36) + " " * (i % 5 == 4) for i in range(400)), "el": "".join(chr(0x3B1 + i * 7 % 24) + " " * (i % 6 == 5) for i in range(400)),
    "en": "the quick brown fox jumps over the lazy dog " * 60, "ru": "".join(chr(0x430 + i * 5 % 32) + " " * (i % 7 == 6) for i in range(400)),
    "zh": "".join(chr(0x4E00 + i * 37 % 1500) for i in range(1500)),
}


def test_many_scripts_keep_their_characters(spark, monkeypatch):
    parts = {lang: t[40:90] for lang, t in SCRIPTS.items()}
    d = docs(spark, [*parts.values(), None, "12"])
    want = [*parts, "und", "und"]
    for cells, languages in ((L.DENSE_CELLS, 256), (0, 256), (40_000, 2)):  # dense, sparse, both and in passes
        monkeypatch.setattr(L, "DENSE_CELLS", cells)
        monkeypatch.setattr(L, "LANGUAGES", languages)
        m = L.Model(SCRIPTS)
        for t, row in zip(parts.values(), m.phrases(list(parts.values()))):
            assert row.tolist() == [plain_phrases(SCRIPTS[lang], t) for lang in m.langs]
        got = {r["doc_id"]: r for r in collect(L.identify(d.drop("lang"), SCRIPTS))}
        assert [got[i]["lang_pred"] for i in range(1, 8)] == want
        assert all(got[i]["score"] > 0.5 for i in range(1, 6)) and got[6]["score"] == 0


def test_any_number_of_labels(spark):
    d = docs(spark, ["abc"] * 300)
    labelled = d.drop("lang").selectExpr("doc_id", "text", "concat('l', doc_id) AS lang")
    assert len(L.fit_texts(labelled)) == 300
