import math

import numpy as np
import pytest

from chunkwright.llm import knn
from chunkwright.llm.knn import hilbert_place, nearest, similar_pairs


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_the_curve_visits_neighbours(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
    place = hilbert_place(grid, bits)
    assert sorted(place.tolist()) == list(range(grid.shape[1]))
    walk = grid[:, np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


def frame(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    for i in range(300):
        x[1000 + i] = x[i] * rng.uniform(0.1, 9) + rng.standard_normal(64) * rng.uniform(0, 0.9)
    x[2000:2040] = x[7]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    bad = [None, [], [1.0] * 63, [0.0] * 64, [math.nan] * 64, [1.0] * 63 + [math.inf], [None] * 64, [1.0] * 63 + [None]]
    rows += [(9000 + i, b, "c") for i, b in enumerate(bad)] + [(None, [1.0] * 64, "c"), (9100, [1e30] * 64, "c"), (9101, [1e-30] * 64, "c")]
    x = x.astype(float)
    return spark.createDataFrame(rows, "chunk_no bigint, embedding array<float>, rank string"), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_and_pairs(spark):
    df, x = frame(spark)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r["key"], []).append(r)
    assert set(got) == set(range(3000)) | {9100, 9101}
    kth = np.sort(s, axis=1)[:, -10]
    hits = 0
    for i in range(3000):
        assert len(got[i]) == 10 and len({r["neighbour"] for r in got[i]}) == 10 and i not in {r["neighbour"] for r in got[i]}
        assert [r["rank"] for r in sorted(got[i], key=lambda r: -r["cosine"])] == list(range(1, 11)) or len({r["cosine"] for r in got[i]}) < 10
        hits += sum(r["neighbour"] >= 9000 or s[i, r["neighbour"]] >= kth[i] - 1e-3 for r in got[i])
    assert hits >= 0.95 * 30_000
    pairs = {tuple(r) for r in similar_pairs(df, 0.9).collect()}
    assert all(a < b and (b >= 9000 or s[a, b] >= 0.9 - 1e-6) for a, b in pairs)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(s >= 0.9)))}
    alone = {(a, b) for a, b in want if not (a == 7 or 2000 <= a < 2040 or b == 7 or 2000 <= b < 2040)}
    assert len(alone - pairs) <= len(alone) // 100 and (9100, 9101) in pairs


def test_windows_reach_over_the_borders_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE", 1)
    monkeypatch.setattr(knn, "TILE_ROWS", 1)
    monkeypatch.setattr(knn, "BLOCK", 1)
    df, _ = frame(spark)
    apart = {(r["key"], r["neighbour"]) for r in nearest(df, curves=1, margin=200).collect()}
    monkeypatch.setattr(knn, "TILE", 100)
    whole = {(r["key"], r["neighbour"]) for r in nearest(df, curves=1, margin=200).collect()}
    assert len(apart & whole) >= 0.97 * len(whole) and len(apart) == len(whole)  # rows of equal cosine may differ


def test_fitted_windows_hold_the_recall(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 64)
    df, x = frame(spark)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -10]
    curves, margin = knn.fitted_windows(knn._rows(df, "chunk_no", "embedding"), 10, 64)
    assert curves * (2 * margin + 64) < 10 * 3000
    results = []
    for parts in (3, 50):
        found = nearest(df.repartition(parts)).collect()
        results.append({(r["key"], r["neighbour"]) for r in found})
        hits = sum(r["key"] < 3000 and (r["neighbour"] >= 9000 or s[r["key"], r["neighbour"]] >= kth[r["key"]] - 1e-3) for r in found)
        assert hits >= 0.9 * 30_000
    assert len(results[0] & results[1]) >= 0.97 * len(results[0])  # only rows of equal cosine differ
    assert knn.fitted_windows(knn._rows(df.limit(0), "chunk_no", "embedding"), 10, 64) == (1, 1)


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    one = rng.standard_normal(64)
    rows = [(i, (one if i % 3 else rng.standard_normal(64)).tolist()) for i in range(1500)]
    found = nearest(spark.createDataFrame(rows, "chunk_no bigint, embedding array<float>")).where("cosine > 0.999").groupBy("key").count().collect()
    assert {r["key"] for r in found} == {i for i in range(1500) if i % 3} and {r["count"] for r in found} == {10}


def test_small_tables(spark):
    df, _ = frame(spark)
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("chunk_no = 5")).count() == 0
    two = nearest(df.where("chunk_no IN (5, 6)")).collect()
    assert {(r["key"], r["neighbour"]) for r in two} == {(5, 6), (6, 5)}
    assert similar_pairs(df.limit(0), 0.9).count() == 0
