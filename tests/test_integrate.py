"""Batch integration: batches meet, clusters stay apart, the ridge equals least squares over cells."""

import numpy as np
import pytest

from meshloom.operators import integrate as op

SCHEMA = "cell_id long, batch string, lab string, emb array<double>, now int, combo string"


def planted(n=600, d=6, seed=1):
    """Three clusters, mixed unevenly over two batches, the second shifted; a second variable shifts too."""
    r = np.random.default_rng(seed)
    centre = 4 * np.eye(d)[:3]
    kind, batch = r.integers(0, 3, n), (r.random(n) < 0.35).astype(int)
    lab = r.integers(0, 2, n)
    shift, other = r.normal(0, 0.6, d), r.normal(0, 0.4, d)
    z = centre[kind] + r.normal(0, 0.25, (n, d)) + batch[:, None] * shift + lab[:, None] * other
    return kind, batch, lab, z


def frame(spark, batch, lab, z):
    return spark.createDataFrame([(i, f"b{b}", f"l{c}", v.tolist(), 7, "x") for i, (b, c, v) in enumerate(zip(batch, lab, z, strict=True))], SCHEMA).repartition(3)


def gap(z, kind, batch):
    """Greatest distance between a cluster's means in the two batches."""
    return max(np.linalg.norm(z[(kind == k) & (batch == 0)].mean(axis=0) - z[(kind == k) & (batch == 1)].mean(axis=0)) for k in range(3))


def test_batches_meet_and_clusters_stay(spark):
    kind, batch, lab, z = planted()
    got = sorted(op.integrate(frame(spark, batch, lab, z), ["batch", "lab"], 6, clusters=8).collect(), key=lambda r: r.cell_id)
    assert len(got) == 600 and got[0].now == 7 and got[0].combo == "x"
    out = np.array([r.emb for r in got])
    assert gap(z, kind, batch) > 0.9 and gap(z, kind, lab) > 0.5
    assert gap(out, kind, batch) < 0.15 and gap(out, kind, lab) < 0.15
    means = np.array([out[kind == k].mean(axis=0) for k in range(3)])
    within = max(np.linalg.norm(out[kind == k] - means[k], axis=1).mean() for k in range(3))
    assert min(np.linalg.norm(means[a] - means[b]) for a in range(3) for b in range(a)) > 4 * within


def test_ridge_is_least_squares_over_cells():
    r = np.random.default_rng(5)
    combos = np.array([[0, 0], [1, 0], [2, 1], [0, 1]])
    which, weight, z = r.integers(0, 4, 200), r.random((200, 2)), r.normal(size=(200, 3))
    n = np.array([weight[which == c].sum(axis=0) for c in range(4)])
    s = np.array([weight[which == c].T @ z[which == c] for c in range(4)])
    moves = op.ridge(n, s, combos, 0.7)
    design = np.hstack([np.ones((200, 1)), np.eye(3)[combos[which, 0]], np.eye(2)[combos[which, 1]]])
    for k in range(2):
        root = np.sqrt(weight[:, k, None])
        held = np.sqrt(0.7) * np.eye(6)[1:]
        want = np.linalg.lstsq(np.vstack([design * root, held]), np.vstack([z * root, np.zeros((5, 3))]), rcond=None)[0]
        assert np.allclose(moves[0][k], want[1:4]) and np.allclose(moves[1][k], want[4:])


def test_memberships_hold_back_batches_that_a_cluster_has_enough_of():
    c = op.Clusters(np.eye(2), 0.1, [np.array([[-1.0, 0.0], [0.0, 0.0]])])
    r = c.memberships(np.array([[1.0, 1.0], [1.0, 1.0], [0.0, 0.0]]), np.array([[0], [1], [1]]))
    assert np.allclose(r.sum(axis=1), 1) and r[0, 0] < r[1, 0] == pytest.approx(0.5) and r[2, 0] == pytest.approx(0.5)


def test_odd_rows(spark):
    rows = [(1, None, "l", [1.0, 0.0], 1, "a"), (1, None, "l", [1.0, 0.0], 1, "a"), (2, "b", "l", None, 1, "a"), (None, "b", "l", [0.0, 0.0], 1, "a"), (4, "b", "l", [0.5, 1.0], 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = op.integrate(df, ["batch"], 2, clusters=3, rounds=2).collect()
    assert len(got) == 5 and [r.emb for r in got if r.cell_id == 2] == [None] and all(np.isfinite(r.emb).all() for r in got if r.emb)
    assert len({tuple(r.emb) for r in got if r.cell_id == 1}) == 1
    one = op.integrate(df.filter("batch = 'b'"), ["batch"], 2)
    assert sorted(map(str, one.collect())) == sorted(map(str, df.filter("batch = 'b'").collect()))
    assert op.integrate(df.limit(0), ["batch"], 2).collect() == []
    with pytest.raises(ValueError, match="combinations"):
        op.integrate(spark.range(1002).selectExpr("id AS cell_id", "id AS batch", "array(1.0D) AS emb"), ["batch"], 1)
