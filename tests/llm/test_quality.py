import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import collect, corpus, docs
from timeloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """Measurements and failed rules of one text."""
    t = text or ""
    words = WORD.findall(t)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(wins)
    repeated = {i + k for i, w in enumerate(wins) if times[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars = len(words), sum(map(len, words))
    symbols, dups, upper = len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(re.findall("[A-Z]", t))
    failed = {
        "min_words": n < 50, "repeated_words": 100 * len(repeated) > 50 * n, "symbols": 10 * symbols > n,
        "duplicate_lines": 2 * dups > len(lines), "word_length": chars < 2 * n or chars > 14 * n, "shouting": 2 * upper > chars,
    }
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": len(repeated)}, {r for r, f in failed.items() if f}


def texts():
    some = corpus(30, 11)
    return some + ["w " * 60, "a b c " * 40, "# $ %\n" * 30, "SHOUTING WORDS " * 30 + some[-1], "\n".join(["same line here"] * 40), "é" * 900 + " x", "x y z " * 60,
                   "a\x0bb\x0cc\x1cd " * 30, some[7], some[7]]


def test_query_matches_brute_force(spark, tmp_path):
    rows = texts()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in collect(Q.op1_quality_rules(spark, str(tmp_path)))}
    assert len(got) == len(rows)
    kinds = set()
    for i, t in enumerate(rows, 1):
        measured, failed = plain(t)
        kinds |= failed
        assert {k: got[i][k] for k in measured} == measured
        assert got[i]["base_failed"] == bool(failed & set(Q.POLICIES["base", 1]))
        assert got[i]["kept"] == (not failed)
        assert got[i]["fail_bits"] == Q.mask(failed)
    assert kinds >= {"min_words", "repeated_words", "symbols", "duplicate_lines", "shouting", "word_length"}


def test_policies_and_ablation_read_the_ledger(spark):
    rows = texts()
    led = Q.ledger(docs(spark, rows))
    failed = [plain(t)[1] for t in rows]
    for policy, rules in Q.POLICIES.items():
        assert Q.apply_policy(led, policy).where("kept").count() == sum(not f & set(rules) for f in failed)
    got = {r["rule"]: r for r in collect(Q.ablation(led))}
    for rule in Q.RULES:
        assert got[rule] == {
            "rule": rule, "n_docs": len(rows), "n_failed": sum(rule in f for f in failed),
            "n_only": sum(f == {rule} for f in failed), "kept_without": sum(not f - {rule} for f in failed)}


def test_filter_keeps_rows_and_columns(spark):
    rows = texts()
    d = docs(spark, rows)
    for clash in ("row", "kept", "n_words", "fail_bits", "flat", "id"):
        d = d.withColumn(clash, F.lit(clash))
    got = Q.filter_documents(d)
    assert got.columns == d.columns
    want = Counter(t for t in rows if not plain(t)[1])
    found = collect(got)
    assert Counter(r["text"] for r in found) == want and all(r["kept"] == "kept" and r["row"] == "row" for r in found)


def test_empty_table_and_null_ids(spark):
    assert collect(Q.ledger(docs(spark, []))) == []
    nulls = docs(spark, [None, "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["fail_bits"] & 1 for r in collect(Q.ledger(nulls))] == [1, 1]
