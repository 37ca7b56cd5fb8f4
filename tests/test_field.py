import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import field

D = 5


def fields(spark, n=40, seed=1):
    r = np.random.default_rng(seed)
    g = r.normal(size=(n, 2, D))
    g[0] = np.outer([1, 2], g[0, 0])  # rank 1
    g[1] = 0
    df = spark.createDataFrame([(0, i, g[i, 0].tolist(), g[i, 1].tolist()) for i in range(n)], "sample int, pt_id long, gx array<double>, gy array<double>")
    return g, df


def test_lengths_are_singular_values(spark):
    g, df = fields(spark)
    for r in field.compress(df, D).collect():
        s = np.linalg.svd(g[r.pt_id], compute_uv=False)
        assert np.allclose([r.len_grad, r.len_ortho], s, atol=1e-6)
        assert abs(r.dx_grad * r.dx_ortho + r.dy_grad * r.dy_ortho) < 1e-12
    for r in field.scalar(df, D).collect():
        assert abs(r.f - np.linalg.svd(g[r.pt_id], compute_uv=False).sum()) < 1e-6
    for r in field.scalar(df, D, norm=True).collect():
        assert abs(r.f - np.linalg.norm(g[r.pt_id])) < 1e-9


def test_decomposition_and_back(spark):
    g, df = fields(spark)
    c = field.compress(df, D)
    keys = ["sample", "pt_id"]
    for r in field.expand(c, field.right_vectors(df, c, keys, D), keys, D).collect():
        assert np.allclose([r.gx, r.gy], g[r.pt_id], atol=1e-6)


def test_f_ignores_rotations_of_the_embedding(spark):
    g, df = fields(spark)
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(D, D)))
    h = g @ q
    turned = spark.createDataFrame([(0, i, h[i, 0].tolist(), h[i, 1].tolist()) for i in range(len(h))], df.schema)
    a, b = ({r.pt_id: r.f for r in field.scalar(x, D).collect()} for x in (df, turned))
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)


@pytest.mark.parametrize("similarity", ["projected", "euclidean"])
def test_edges_are_aligned_by_procrustes(spark, similarity):
    """A path of three points: the filter against numpy's decomposition."""
    pts = np.array([[0.0, 0.0], [1.0, 0.2], [1.7, 1.0]])
    g = np.random.default_rng(4).normal(size=(2, 2, D))
    ends = [(0, 1), (1, 2)]
    e = spark.createDataFrame([(0, k + 1, a, b, *map(float, (pts[a][0], pts[b][0], pts[a][1], pts[b][1]))) for k, (a, b) in enumerate(ends)], "sample int, edge_id long, from_pt long, to_pt long, x0_pt double, x1_pt double, y0_pt double, y1_pt double")
    f = spark.createDataFrame([(0, k + 1, g[k, 0].tolist(), g[k, 1].tolist()) for k in range(2)], "sample int, edge_id long, gx array<double>, gy array<double>")
    got = {r.edge_id - 1: np.array([r.gx, r.gy]) for r in field.smooth_edges(f, e, D, "projected", similarity).collect()}
    for i, (a, b) in enumerate(ends):
        d, s, who = [], [], []
        for at, other in ((a, b), (b, a)):
            for j, pair in enumerate(ends):
                if at in pair:
                    far = pair[1] if pair[0] == at else pair[0]
                    d.append(np.linalg.norm(g[i].T @ (pts[far] - pts[other])) / 2)
                    u, _, vt = np.linalg.svd(g[i] @ g[j].T)
                    turned = u @ vt @ g[j]
                    s.append(np.linalg.norm(turned - g[i]) if similarity == "euclidean" else max(0.0, 1 - (turned * g[i]).sum() / (np.linalg.norm(g[i]) * np.linalg.norm(g[j]))))
                    who.append(j)
        d, s = np.array(d), np.array(s)
        phi = np.exp(-(d**2) / (2 * (d.mean() or 1) ** 2) - s**2 / (2 * (s.mean() or 1) ** 2))
        assert np.allclose(got[i], sum(p * g[j] for p, j in zip(phi / phi.sum(), who, strict=True)), atol=1e-6)


def test_modes(spark):
    _, df = fields(spark, 3)
    e = df.select("sample", F.col("pt_id").alias("edge_id"), "gx", "gy")
    assert field.smooth_edges(e, e, D, "none", "projected") is e
    with pytest.raises(ValueError, match="distance"):
        field.smooth_edges(e, e, D, "far", "projected")
