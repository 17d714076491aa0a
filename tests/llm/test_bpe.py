import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from tests.llm.helpers import collect, corpus, docs
from timeloom.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.multilingual()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def awkward():
    r = random.Random(5)
    return ["<|endoftext|> I'll  go\n\n  \t", "naïve 漢字 😀😀 ١٢٣", "a" * 3000, " " * 700 + "x", "ab" * 400 + "abc" * 300, "\n" * 500,
            "".join(r.choice("abcdefgh") for _ in range(1500)), "xyz" + "a" * 2000 + "b" * 1001, "x" + "ab" * 2000,
            "".join(chr(0x4E00 + r.randrange(900)) for _ in range(4000)), "é" * 333, "".join(r.choice("aab") for _ in range(900)), "\x00\x1f​"]


def test_same_as_the_library(spark, vocabulary, library):
    texts = corpus(40) + awkward()
    got = {r["doc_id"]: r for r in collect(bpe.round_trip(docs(spark, texts), vocabulary))}
    for i, t in enumerate(texts, 1):
        want = library.encode_ordinary(t or "")
        assert bytes(got[i]["ids"]) == b"".join(x.to_bytes(4, "little") for x in want)
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_digests_and_separate_ways(spark, vocabulary, library):
    texts = ["one two", None, "drei", "drei"]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in collect(bpe.digests(d, vocabulary))}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["n_tokens"] == len(library.encode_ordinary("one two"))
    back = {r["doc_id"]: r for r in collect(bpe.decode(bpe.encode(d, vocabulary), vocabulary))}
    assert bytes(back[3]["decoded"]) == b"drei" and back[1]["key"] == "x"
    assert collect(bpe.digests(docs(spark, []), vocabulary)) == []


def test_memory_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 2000)
    monkeypatch.setattr(bpe, "ROWS", 40)
    monkeypatch.setattr(bpe, "PIECE", 12)
    monkeypatch.setattr(bpe, "IDS", 7)
    worker = bpe.Worker(vocabulary)
    for t in corpus(5)[5:] + ["a" * 99, "xyabcabcabcabcabcq" * 9]:
        ids = worker.encode([t, "", t])
        assert ids[0] == ids[2] == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t))
        assert worker.decode(ids) == [t.encode(), b"", t.encode()]
    worker.close()


def test_very_long_words(vocabulary, library):
    r = random.Random(1)
    worker = bpe.Worker(vocabulary)
    for t in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "".join(chr(0x3041 + r.randrange(80)) for _ in range(60_000))):
        assert worker.encode([t]) == [b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t))]
    worker.close()


def test_own_columns_of_the_same_names(spark, vocabulary):
    d = docs(spark, ["one two", None]).selectExpr("*", "'mine' AS ids", "'mine' AS decoded")
    out = bpe.decode(bpe.encode(d, vocabulary), vocabulary)
    assert sorted(out.columns) == sorted(["doc_id", "lang", "source", "n_chars", "key", "ids", "decoded"])
    assert {bytes(r["decoded"]) for r in collect(out)} == {b"one two", b""}
    assert bpe.digests(d, vocabulary).count() == 2
