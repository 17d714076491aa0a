"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps the measurements and one failure bit a
rule. Policies are named, versioned sets of rules; applying one, or asking what a rule changes, only
touches the ledger's integers, never the texts. DataFrame functions alone, no Python on executors.

Cases: a null or blank text has no words and so fails MIN_WORDS; repeated rows are judged each for
itself, and rows without an id like any other; an empty table gives an empty ledger; further columns stay out of the way (only `id_col` and
`text_col` are read; `filter_documents` returns all columns as they came);
very long texts are measured whole, in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, cut, load

#: Bit of each rule in the ledger, in the order in which they were introduced; never renumbered.
RULES = ("min_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting")
#: Versions of each policy: the rules that reject.
POLICIES = {
    ("base", 1): ("min_words", "repeated_words"),
    ("web", 1): ("min_words", "repeated_words", "symbols"),
    ("web", 2): RULES,
}
CURRENT = ("web", 2)
WINDOW = 3


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _windows(words: Column) -> Column:
    """64-bit hashes of the three-word windows, in order."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper (A-Z), all long.

    Repeated words: a text whose windows are all distinct has none. Else the windows are sorted with
    their positions inside the row; equal neighbours are repeats; the words covered are the sum of the
    steps between repeated positions, three at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split(text, GAP), "").alias("words"),
        F.regexp_replace(text, "[^#*$%&|<>A-Z]+", "").alias("marks"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    d = d.select(
        "doc_id",
        F.length(F.regexp_replace("marks", "[A-Z]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("marks", "[^A-Z]+", "")).alias("n_upper"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("words").alias("n_words"),
        _windows(F.col("words")).alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    none = F.array().cast("array<struct<w:bigint,i:int>>")
    d = d.withColumn("sorted", F.when(distinct, none).otherwise(placed)).drop("windows")
    following = F.slice("sorted", F.lit(2), F.greatest(F.size("sorted"), F.lit(1)))
    pairs = F.array_compact(F.zip_with(
        F.col("sorted"), following,
        lambda a, b: F.when(a["w"] == b["w"], F.struct(a["i"].alias("x"), b["i"].alias("y"))),
    ))
    d = d.withColumn("pairs", pairs)
    d = d.withColumn("at", F.sort_array(F.array_union(F.col("pairs.x"), F.col("pairs.y"))))
    steps = F.zip_with(
        F.col("at"), F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda s, x: s + x))
    return d.select("doc_id", *(
        F.col(c).cast("long").alias(c)
        for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
    ))


def _failed() -> dict[str, Column]:
    c = F.col
    return {
        "min_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")),
        "shouting": 2 * c("n_upper") > c("word_chars"),
    }


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table: policies and ablations read its integers, texts are never measured again."""
    return cut(ledger(docs), "ledger")


def policies(led: DataFrame) -> DataFrame:
    """Every policy's version over one ledger: policy, version, n_docs, n_kept. One pass over the bits, which
    shrink to at most 2^rules distinct masks first."""
    n = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(name).alias("policy"), F.lit(version).alias("version"), F.lit(mask(rules)).cast("long").alias("mask"))
                     for (name, version), rules in POLICIES.items()))
    n = n.select("fail_bits", "n", F.inline(rows))
    kept = F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0))
    return n.groupBy("policy", "version").agg(F.sum("n").alias("n_docs"), kept.alias("n_kept"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus `fail_bits` (long): bit i is set if RULES[i] fails.

    The measurements pass through a generator of one row: Catalyst would push a filter on the bits
    below the projections that measure, and so write out, and evaluate, each of them many times."""
    bits = F.lit(0).cast("long")
    for name, failed in _failed().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(mask([name]))).otherwise(F.lit(0)).cast("long"))
    measured = measure(docs, id_col, text_col)
    names = [c for c in measured.columns if c != "doc_id"]
    return measured.select("doc_id", F.inline(F.array(F.struct(*names)))).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """Adds `kept`: no rule of the policy's version failed. Reads the bits only."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(led: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """What each rule of a policy does: rule, n_docs, n_failed, n_only (rejected by this rule alone)
    and kept_without. One pass: the ledger shrinks to at most 2^rules distinct masks first."""
    whole = mask(POLICIES[policy])
    n = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit"))
        for r in POLICIES[policy]
    ))
    n = n.select("bits", "n", F.inline(rules))
    count_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return n.groupBy("rule").agg(
        F.sum("n").alias("n_docs"),
        count_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count_if(F.col("bits") == F.col("bit")).alias("n_only"),
        count_if(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def filter_documents(docs: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    led = ledger(packed.select("row", F.col("row.text").alias("text")), "row", "text")
    return apply_policy(led, policy).where("kept").select("doc_id.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(load(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base", 1]))) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )


def quality_policies(spark, sf_dir: str) -> DataFrame:
    return policies(stored_ledger(load(spark, sf_dir, "documents")))


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    return ablation(stored_ledger(load(spark, sf_dir, "documents")))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT doc_id, p, list_slice(w, p, p + 2) AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT
    + 32 * (2 * n_upper > word_chars)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

POLICIES_SQL = f"""SELECT policy, version, count(*)::BIGINT AS n_docs, (count(*) FILTER ((fail_bits & mask) = 0))::BIGINT AS n_kept
FROM ({OP1_SQL}), (VALUES {", ".join(f"('{n}', {v}, {mask(r)})" for (n, v), r in POLICIES.items())}) AS p(policy, version, mask) GROUP BY policy, version"""
ABLATION_SQL = f"""SELECT rule, count(*)::BIGINT AS n_docs, (count(*) FILTER ((fail_bits & bit) <> 0))::BIGINT AS n_failed, (count(*) FILTER ((fail_bits & {mask(POLICIES[CURRENT])}) = bit))::BIGINT AS n_only,
(count(*) FILTER ((fail_bits & {mask(POLICIES[CURRENT])} & ~bit) = 0))::BIGINT AS kept_without
FROM ({OP1_SQL}), (VALUES {", ".join(f"('{r}', {mask([r])})" for r in POLICIES[CURRENT])}) AS p(rule, bit) GROUP BY rule"""
