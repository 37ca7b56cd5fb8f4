"""Components of z-scores from sparse counts against numpy's decomposition of the dense matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import embed


def dense(rows):
    """Clipped z-scores of (cell, gene, value), absent ones as zero, genes without spread left out."""
    cells, genes = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    x = np.zeros((len(cells), len(genes)))
    for _, c, g, v in rows:
        x[cells.index(c), genes.index(g)] = v
    keep = x.std(axis=0) > 0
    x = x[:, keep]
    return cells, np.clip((x - x.mean(axis=0)) / x.std(axis=0, ddof=1), -10, 10)


def sparse_rows(sample, cells, genes, seed, share=0.15):
    r = np.random.default_rng(seed)
    out = [(sample, i, f"g{j:03}", float(np.log1p(r.integers(1, 9) * (1 + (i % 3 == j % 3) * 3)))) for i in range(cells) for j in range(genes) if r.random() < share]
    return out + [(sample, cells, "g000", 1.0), (sample, 0, "lone", 0.0)]


@pytest.mark.parametrize(("genes", "npcs", "chunk", "bases"), [(12, 20, 50_000, 20_000_000), (80, 4, 50_000, 20_000_000), (80, 4, 40, 1500)])
def test_against_the_dense_decomposition(spark, monkeypatch, genes, npcs, chunk, bases):
    monkeypatch.setattr(embed, "CHUNK", chunk)
    monkeypatch.setattr(embed, "BASES", bases)
    samples = {"a": sparse_rows("a", 150, genes, 1), "b": sparse_rows("b", 90, genes, 2)}
    df = spark.createDataFrame(sum(samples.values(), []), "sample string, cell_id long, gene string, value double").repartition(3)
    emb, loadings = embed.pca_of(df, npcs)
    for s, rows in samples.items():
        cells, z = dense(rows)
        _, value, vector = np.linalg.svd(z, full_matrices=False)
        found = {r.cell_id: r.emb for r in emb.filter(F.col("sample") == s).collect()}
        assert sorted(found) == cells
        got = np.array([found[c] for c in cells])
        k = got.shape[1]
        assert k == min(npcs, int((value**2 > 1e-9 * value[0] ** 2).sum()))
        want = z @ vector[:k].T
        assert np.allclose(got @ got.T, want @ want.T, atol=1e-5)
        own = loadings.filter(F.col("sample") == s).orderBy("gene").collect()
        u = np.array([r.loading for r in own])
        assert np.allclose(u.T @ u, np.eye(k), atol=1e-8) and np.allclose(z @ u, got, atol=1e-8) and "lone" not in {r.gene for r in own}
        assert (u[np.abs(u).argmax(axis=0), np.arange(k)] > 0).all()


def test_nothing_to_decompose(spark):
    schema = "sample int, cell_id long, gene string, value double"
    for rows in ([], [(1, 1, "a", 2.0)], [(1, 1, "a", 2.0), (1, 2, "a", 2.0)]):
        emb, loadings = embed.pca_of(spark.createDataFrame(rows, schema), 3)
        assert emb.collect() == [] and loadings.collect() == [] and emb.columns == ["sample", "cell_id", "emb"]


@pytest.mark.parametrize(("bases", "rounds"), [(20_000_000, 3), (1500, 60)])
def test_a_flat_spectrum_settles(spark, monkeypatch, bases, rounds):
    """Components of noise are nearly as strong as each other; a space of all genes takes genes / block rounds. With less room it starts again from the leading directions."""
    monkeypatch.setattr(embed, "BASES", bases)
    genes = 40 if bases > 1500 else 70
    r = np.random.default_rng(5)
    rows = [(0, i, f"g{j:03}", float(v)) for i, x in enumerate(r.normal(size=(500, genes))) for j, v in enumerate(x)]
    emb, _ = embed.pca_of(spark.createDataFrame(rows, "sample int, cell_id long, gene string, value double").repartition(3), 6, max_rounds=rounds)
    cells, z = dense(rows)
    _, value, vector = np.linalg.svd(z, full_matrices=False)
    found = {x.cell_id: x.emb for x in emb.collect()}
    got, want = np.array([found[c] for c in cells]), z @ vector[:6].T
    assert value[6] > 0.8 * value[5] and np.allclose(np.abs(got), np.abs(want), atol=1e-4)
