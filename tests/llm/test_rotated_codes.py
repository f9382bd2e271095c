import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import queries, rotated_codes


def _brute(ids, vectors, k):
    """{query position: [(score, id), ...]} of the nearest, ties to the smaller id."""
    scores = vectors @ vectors.T
    out = {}
    for q in range(len(ids)):
        rest = [(-scores[q, i], ids[i]) for i in range(len(ids)) if i != q]
        out[q] = [(-s, i) for s, i in sorted(rest)[:k]]
    return out


def test_recall_and_scores_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    vectors = np.array([r["embedding"] for r in rows], np.float64)
    expected = _brute(ids, vectors, 20)
    found = {}
    for r in queries.op4_nearest(spark, sf).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        hits += len({g[1] for g in got} & {i for _, i in expected[q]})
        for _, i, score in got:
            assert score == pytest.approx(vectors[i] @ vectors[q], abs=1e-12)
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(got, got[1:]))
    assert hits / (20 * len(found)) >= 0.99


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(0)
    vectors, queries_ = rng.normal(size=(3000, 48)) + 0.3, rng.normal(size=(20, 48))
    mean, turn = vectors.mean(axis=0), rotated_codes.rotation(48)
    codes, length, factor = rotated_codes.encode(vectors, mean, turn)
    assert codes.shape == (3000, 6)
    about, error = rotated_codes.estimate(codes, length, factor, queries_, mean, turn)
    off = np.abs(about - queries_ @ vectors.T) / error
    assert (off > 3).mean() < 0.005 and 0.5 < np.sqrt((off**2).mean()) < 1.5


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 2.0]),
        (20, [1.0, 0.0, 2.0]),
        (1, [1.0, 0.0, 2.0]),
        (1, [1.0, 0.0, 2.0]),
        (None, [0.5, 0.5, 0.5]),
        (2, None),
        (3, [0.0, 0.0, 0.0]),
        (4, [nan, 1.0, 1.0]),
        (5, [inf, 1.0, 1.0]),
        (6, [None, 1.0, 1.0]),
        (7, [1.0]),
        (40, []),
        (60, [0.0, -1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, code string")
    index = rotated_codes.build_index(df)
    found = {}
    for r in rotated_codes.search(index, index.filter("key % 20 = 0"), 4).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(f) for q, f in found.items()} == {
        0: [(1, 1, 5.0), (2, 1, 5.0), (3, 20, 5.0), (4, None, 1.5)],
        20: [(1, 0, 5.0), (2, 1, 5.0), (3, 1, 5.0), (4, None, 1.5)],
        60: [(1, 0, 0.0), (2, 1, 0.0), (3, 1, 0.0), (4, 20, 0.0)],
    }


def test_empty_tables_and_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0])], "vec_id long, embedding array<float>")
    index = rotated_codes.build_index(df)
    found = rotated_codes.search(index, index.filter("key % 20 = 0"), 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == [(0, 1, 20, 4.0), (20, 1, 0, 4.0)]
    for rows in (df.limit(0), df.filter("vec_id = 0")):
        index = rotated_codes.build_index(rows)
        assert rotated_codes.search(index, index.filter("key % 20 = 0"), 20).count() == 0
    assert rotated_codes.search(rotated_codes.build_index(df), rotated_codes.build_index(df).filter(F.lit(False)), 3).count() == 0


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 16)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(rotated_codes, "BLOCK", 17)
    monkeypatch.setattr(rotated_codes, "QUERY_BLOCK", 9)
    index = rotated_codes.build_index(df)
    found = {}
    for r in rotated_codes.search(index, index, 5, bound=6.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    expected = _brute(np.arange(150), vectors, 5)
    for q, got in found.items():
        best = [round(vectors[i] @ vectors[q], 9) for _, i in sorted(got)]
        assert best == [round(s, 9) for s, _ in expected[q]]
    assert len(found) == 150
