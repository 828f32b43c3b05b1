from __future__ import annotations

import numpy as np

from docmill.llm.neighbours import cells_wanted, encode, fit, nearest_neighbours


def clustered(n=1200, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 30, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)


def exact(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


def recall(got, x, k):
    want = exact(x, k)
    found = {(r.id, r.other) for r in got}
    return np.mean([(f"v{i:05}", f"v{j:05}") in found for i in range(len(x)) for j in want[i]])


def table(spark, x, extra=()):
    return spark.createDataFrame([(f"v{i:05}", v.tolist(), 0) for i, v in enumerate(x)] + list(extra), "id string, vector array<float>, cell int")


def test_recall_of_ten(spark):
    x = clustered()
    got = nearest_neighbours(table(spark, x), dim=16, cell_rows=100, rerank=60).collect()
    assert len(got) == len(x) * 10
    assert recall(got, x, 10) >= 0.97
    assert all(abs(r.score) <= 1 + 1e-9 for r in got)


def test_blocks_of_a_large_cell_lose_nothing(spark):
    x = clustered(600)
    got = nearest_neighbours(table(spark, x), dim=16, cell_rows=10_000, block_rows=100, rerank=600).collect()
    assert recall(got, x, 10) == 1.0  # one cell, all of it ranked exactly


def test_copies_of_a_vector(spark):
    x = clustered(300)
    x[100:200] = x[100]  # a third of all rows
    got = nearest_neighbours(table(spark, x), dim=16, k=5, cell_rows=1000, rerank=300).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.other, r.score))
    assert len(by) == 300 and all(len(v) == 5 for v in by.values())
    assert {o for o, _ in by["v00150"]} == {f"v{i:05}" for i in range(100, 105)}
    assert {o for o, _ in by["v00101"]} == {f"v{i:05}" for i in (100, 102, 103, 104, 105)}


def test_unusable_vectors(spark):
    x = clustered(60)
    nan = float("nan")
    extra = [("zero", [0.0] * 16, 1), ("short", [1.0] * 8, 1), ("none", None, 1), ("nan", [nan] + [1.0] * 15, 1), ("hole", [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), ("v00001", x[1].tolist(), 1)]
    got = nearest_neighbours(table(spark, x, extra), dim=16, k=3).collect()
    assert {r.id for r in got} == {f"v{i:05}" for i in range(60)}
    assert len(got) == 180


def test_small_tables(spark):
    x = clustered(60)
    assert nearest_neighbours(table(spark, x).limit(0), dim=16).count() == 0
    assert nearest_neighbours(table(spark, x).limit(1), dim=16).count() == 0
    assert nearest_neighbours(table(spark, x[:3]), dim=16).count() == 6


def test_beam_search_is_no_worse_than_greedy():
    x = clustered(500)
    model = fit(x, 1, 1, 4, 16)
    rest = (x - model.centres[0]) / model.scale[0]
    errors = [((rest - encode(rest, model.books, b)[1]) ** 2).sum() for b in (1, 8)]
    assert errors[1] <= errors[0]


def test_cells_grow_with_the_rows():
    """Rows a cell, and so the copies that a query's probes make, stay as they are while the sample stays as large."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 16))
    means = []
    for n in (10_000, 100_000, 1_000_000):
        x = (centres[rng.integers(0, 300, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        many, within = cells_wanted(n, 2000, 100)
        assert many <= 250 and many * within >= n // 100
        counts = np.bincount(fit(x[:2000], many, within, 2, 16).near(x, 4)[:, 0])
        means.append((counts**2).sum() / n)  # rows of the cell of a row, on average
    assert max(means) < 8 * min(means)  # of a hundred times as many rows


def test_recall_with_words_within_centres(spark):
    x = clustered(3000)
    got = nearest_neighbours(table(spark, x), dim=16, cell_rows=50, rerank=60, probes=8, sample_rows=160).collect()
    assert recall(got, x, 10) >= 0.9


def test_a_tight_group_of_different_vectors(spark):
    """A third of all rows within a small ball: its codes are in its own scale."""
    x = clustered(900)
    x[300:600] = x[300] + 0.003 * np.random.default_rng(4).normal(size=(300, 16))
    got = nearest_neighbours(table(spark, x), dim=16, cell_rows=100, rerank=60).collect()
    want = exact(x, 10)
    found = {(r.id, r.other) for r in got}
    assert np.mean([(f"v{i:05}", f"v{j:05}") in found for i in range(300, 600) for j in want[i]]) >= 0.9
