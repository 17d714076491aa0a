"""Small corpora with every awkward case, and brute-force helpers."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
])


def docs(spark, texts, start=1):
    """texts: strings or None; an extra column with a name that operators use inside."""
    rows = [(start + i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def corpus(n=60, seed=7, vocabulary=400, low=5, high=120):
    """Random texts with exact copies, near copies, shared passages, blanks and a null."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\t "]) for _ in range(k))
    passage = text(40)
    out = [None, "", " \n\t", "one", "one two three"]
    for _ in range(n):
        t = text(r.randint(low, high))
        out.append(t)
        kind = r.random()
        if kind < 0.15:
            out.append(t)
        elif kind < 0.3:
            w = t.split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        elif kind < 0.45:
            out.append(text(20) + passage + text(20))
    return out


def collect(df):
    return [r.asDict() for r in df.collect()]
