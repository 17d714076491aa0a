import numpy as np

from tests.llm.helpers import collect
from timeloom.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 500)
    monkeypatch.setattr(ann, "QUERY_WAVE", 10)
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 30))
    x = (centres[r.integers(0, 8, 3000)] + r.normal(size=(3000, 30)) * 0.7) * r.uniform(0.5, 2, (3000, 1))
    x = x.astype(np.float32)
    x[100:160] = x[100]  # copies: ties
    df = frame(spark, [(i, [float(c) for c in v], "z") for i, v in enumerate(x)])
    got = {}
    for row in collect(ann.nearest(df, df.where("vec_id % 100 = 0"))):
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        hits += len({v for v, _ in got[q].values()} & set(want.tolist()))
        for v, s in got[q].values():
            assert abs(s - d[v]) < 1e-9
    assert hits >= 0.95 * 300
    assert [got[100][k][0] for k in range(1, 11)] == list(range(101, 111))


def test_anisotropic_codes_have_less_parallel_error():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 16))
    books, eta = ann.fit(x), ann._parallel_weight(400)
    err = {}
    for e in (1.0, eta):
        codes = ann.encode(x, books, e)
        res = x - books[np.arange(8)[None], codes].reshape(len(x), -1)
        err[e] = np.mean(((res * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2)
    assert err[eta] < err[1.0]


def test_awkward_rows(spark):
    assert collect(ann.nearest(frame(spark, []), frame(spark, []))) == []
    nan = float("nan")
    df = frame(spark, [(0, [1.0, 0.0], ""), (0, [1.0, 0.0], ""), (1, None, ""), (2, [0.0, 0.0], ""), (3, [nan, 1.0], ""), (4, [None, 1.0], ""),
                       (5, [1.0, 1.0], ""), (6, [float("inf"), 1.0], ""), (None, [1.0, 2.0], ""), (7, [1.0], ""), (8, [1.0, 1.0], "")])
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(ann.nearest(df, df.where("vec_id = 0")).orderBy("rank"))]
    assert got == [(0, 1, 5, 1.0), (0, 2, 8, 1.0)]


def test_many_copies_take_no_place_of_others(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 24)).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[1:181:3], 150, axis=0)])
    df = frame(spark, [(i, [float(c) for c in v], "z") for i, v in enumerate(x)])
    got = {}
    for row in collect(ann.nearest(df, df.where("vec_id < 900 and vec_id % 30 = 0"))):
        got.setdefault(row["query_id"], []).append(row["score"])
    hits = 0
    for q in range(0, 900, 30):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += sum(a <= np.sort(d)[9] + 1e-9 for a in got[q])
    assert hits >= 0.95 * 300


def test_length_is_the_most_common_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 1)
    for other in range(100, 106):  # one of them has the least hash
        df = frame(spark, [(i, [1.0, float(i)], "") for i in range(5)] + [(other, [1.0], "")])
        assert [r["vec_id"] for r in collect(ann.nearest(df, df.where("vec_id = 0")).orderBy("rank"))] == [1, 2, 3, 4]


def _recall(x, rerank=ann.RERANK, step=100):
    """Share of the ten nearest that are among the best `rerank` of a scan of all codes."""
    books, eta = ann.fit(x[: ann.SAMPLE]), ann._parallel_weight(x.shape[1])
    codes = np.concatenate([ann.encode(ann._padded(x[a : a + 512]), books, eta) for a in range(0, len(x), 512)])
    near = books[np.arange(books.shape[0])[None], codes].reshape(len(x), -1)[:, : x.shape[1]]
    half, hits, n = (x * x).sum(axis=1) / 2, 0, 0
    for q in range(0, len(x), step):
        score = near @ x[q] - half
        d = ((x - x[q]) ** 2).sum(axis=1)
        score[q], d[q] = -np.inf, np.inf
        hits += len(set(np.argsort(-score)[:rerank].tolist()) & set(np.argsort(d, kind="stable")[:10].tolist()))
        n += 10
    return hits / n


def test_recall_of_the_given_table(spark):
    x = np.array(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(20_000).toPandas()["embedding"].tolist(), float)
    share = _recall(x)
    print("recall on the given vectors", x.shape, share)
    assert share >= 0.9


def test_recall_at_many_dimensions():
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 24)) @ r.normal(size=(24, 768)) + r.normal(size=(2000, 768))
    share = _recall(x)
    print("recall at 768 dimensions", share)
    assert share >= 0.9


def test_rows_that_codes_say_little_about(spark, monkeypatch):
    """Tight groups, no structure, lengths of all sizes, far from the origin: each is as near as brute force finds."""
    monkeypatch.setattr(ann, "ROW_BLOCK", 700)
    r = np.random.default_rng(6)
    tight = np.repeat(r.normal(size=(4, 20)), 500, axis=0) + r.normal(size=(2000, 20)) * 1e-3
    plain = r.uniform(-1, 1, (2000, 64))
    sizes = r.normal(size=(2000, 20)) * 10.0 ** r.uniform(-4, 4, (2000, 1))
    away = r.normal(size=(2000, 20)) + 1e4
    ties = r.integers(0, 2, (2000, 12)) * 1.0
    for x in (tight, plain, sizes, away, ties):
        x = x.astype(np.float32)
        df = frame(spark, [(i, [float(c) for c in v], "z") for i, v in enumerate(x)])
        got = {}
        for row in collect(ann.nearest(df, df.where("vec_id % 100 = 0"), rerank=16)):
            got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
        for q in range(0, 2000, 100):
            d = np.zeros(len(x))
            for a, b in zip(x.astype(float).T, x[q].astype(float), strict=True):
                d += (b - a) * (b - a)
            d = np.sqrt(d)
            d[q] = np.inf
            usable = (x != 0).any(axis=1)
            d[~usable] = np.inf
            if usable[q]:
                assert [got[q][k] for k in range(1, 11)] == np.lexsort((np.arange(len(x)), d))[:10].tolist()
