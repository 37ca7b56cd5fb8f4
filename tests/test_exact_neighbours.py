"""Exact neighbours by cells against all pairs: copies, zero vectors, ties, and how much of the table a row asks."""

import numpy as np
import pytest

from meshloom.operators import analysis


def brute(ids, v, k):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(d, np.inf)
    return {i: [(ids[j], d[n, j]) for j in sorted(range(len(ids)), key=lambda j: (d[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


@pytest.mark.parametrize("block", [16, 64])
def test_cells_give_what_all_pairs_give(spark, block):
    r = np.random.default_rng(8)
    v = r.normal(size=(700, 4))
    v[50:250] = v[50]  # one vector's copies
    v[300:303] = 0
    v[310] = 2 * v[50]
    ids = r.permutation(700).tolist()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)] + [(900, None), (901, [float("nan")] * 4)], "id long, emb array<double>")
    got: dict = {}
    for x in analysis.knn(df, 5, block=block).orderBy("id", "rank").collect():
        got.setdefault(x.id, []).append((x.other, x.distance))
    want = brute(ids, v, 5)
    assert got.keys() == want.keys()
    for i, near in want.items():
        assert [n[0] for n in got[i]] == [n[0] for n in near] and np.allclose([n[1] for n in got[i]], [n[1] for n in near], atol=1e-11)


def test_a_row_asks_few_cells(spark, monkeypatch):
    """All pairs were 4,000 x 4,000; the cells asked hold far fewer."""
    met, real = spark.sparkContext.accumulator(0), analysis._nearest

    def counted(x, y, k):
        met.add(len(x) * len(y))
        return real(x, y, k)

    monkeypatch.setattr(analysis, "_nearest", counted)
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(4000, 3)))], "id long, emb array<double>")
    assert analysis.knn(df, 5, block=64).count() == 20_000
    assert 0 < met.value < 4000 * 4000 / 4
