"""Integer clustering through ball trees and product codes: against their SQL, brute force and odd rows."""

import duckdb
import numpy as np
import pytest

from meshloom.llm import ball_tree, integers, queries, vector_codes


def groups(n=900, d=64, seed=4, spread=0.02):
    """Tight groups, copies, ties and odd rows."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, d))[r.integers(0, 12, n)] + r.normal(0, spread, (n, d))
    x[:200] = x[0]
    x[200:220] = np.round(x[200:220])
    rows = [(int(i), v.tolist(), int(i % 3) if i % 7 else None) for i, v in enumerate(x)]
    bad = [None] + [float("nan")] * 2 + [0.1] * (d - 3)
    return rows + [(2000, None, 1), (2001, bad, 1), (2002, [float("inf")] + [0.0] * (d - 1), 2), (2003, [0.0] * d, None)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("name", "spread"), [("op12_ball_tree_clusters", 0.02), ("op12_ball_tree_clusters", 1.0), ("op13_vector_codes", 0.3)])
def test_against_sql(spark, tmp_path, name, spread):
    spark.createDataFrame(groups(spread=spread), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall()) and len(got) == 901


@pytest.mark.parametrize("spread", [0.02, 0.5, 3.0])
def test_trees_against_all_distances(spread):
    x = integers.floors(np.array([r[1] for r in groups(spread=spread) if r[0] < 2000]), 256)
    c = x[::60].copy()
    c[3] = c[2]  # equal centroids: the smaller number
    tree, order = ball_tree.grow(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (tree.points == x[order]).all()
    inner = tree.left >= 0
    assert (tree.count[inner] == tree.count[tree.left[inner]] + tree.count[tree.right[inner]]).all()
    d = ((tree.points[:, None] - c) ** 2).sum(axis=2)
    which, far = ball_tree.assign(tree, c)
    assert (which == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
    ball_tree.sums(tree, c, total, count)
    assert all((total[k] == tree.points[which == k].sum(axis=0)).all() and count[k] == (which == k).sum() for k in range(len(c)))
    apart = [x[0]]
    for v in x:
        if min(((v - u) ** 2).sum() for u in apart) > 64 * 100**2:
            apart.append(v)
    balls, _, rows = ball_tree.settle(tree, np.array(apart[:12]))
    assert tree.count[balls].sum() + len(rows) == len(x)
    if spread < 0.1:
        assert len(rows) < len(x) / 10  # a centroid a group: nearly all points lie in balls that move as a whole


def test_exact_products_beyond_doubles():
    r = np.random.default_rng(0)
    a, b = r.integers(-integers.BOUND, integers.BOUND, (40, 64)), r.integers(-integers.BOUND, integers.BOUND, (9, 64))
    want = [[min((sum((int(x) - int(y)) ** 2 for x, y in zip(u, v, strict=True)), k) for k, v in enumerate(b))] for u in a]
    which, far = integers.nearest(a, b)
    assert [[(int(f), int(w))] for f, w in zip(far, which, strict=True)] == want
    assert (integers.product(a, b) == a @ b.T).all() and integers.floors(np.array([-0.001, 1e30]), 256).tolist() == [-1, integers.BOUND]


def test_odd_rows_of_clusters(spark):
    rows = [(1, [0.5] * 4, 0, "x"), (1, [0.5] * 4, 0, "x"), (None, [1.0] * 4, 1, "y"), (3, [1e30] * 4, 1, "z"), (4, [1.0] * 3, 1, "z"), (5, [], 1, "z"), (6, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, id string")
    got = ball_tree.cluster(df, dims=4, centroids=4, rounds=2).collect()
    assert len(got) == 4 and {r.id for r in got} == {1, None, 3} and all(r.distance == 0 for r in got)
    few = ball_tree.cluster(df.filter("vec_id = 1"), dims=4).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in few] == [(0, 0, 0)] * 2
    assert ball_tree.cluster(df.limit(0)).collect() == []


def test_odd_rows_of_codes(spark):
    rows = [(i, [float(i), 0.0, -1.0, 2.0, 0.25, 0.0], None if i % 2 else 1, "x") for i in range(6)] + [(0, [0.0, 0.0, -1.0, 2.0, 0.25, 0.0], 1, "x"), (None, [9.0] * 6, 2, "y"), (8, [1.0] * 5, 1, "z"), (9, [], 1, "z"), (10, None, None, None), (11, [None] * 6, 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    got = sorted(vector_codes.compress(df, entries=3).collect(), key=str)
    assert len(got) == 8 and len({r.codebooks_sha256 for r in got}) == 1 and all(len(r.code) == 8 for r in got)
    by_label = {}
    for r in got:
        kind = "none" if r.id in (1, 3, 5) else "two" if r.id is None else "one"
        by_label.setdefault(kind, []).append((r.error, r.label_error))
    assert all({t for _, t in v} == {sum(e for e, _ in v)} for v in by_label.values()) and len(by_label) == 3
    assert all(r.error == 0 for r in vector_codes.compress(df.filter("vec_id < 6")).collect())
    assert vector_codes.compress(df.limit(0)).collect() == [] and vector_codes.compress(df.filter("vec_id = 9")).collect() == []
    with pytest.raises(ValueError, match="entries"):
        vector_codes.compress(df, entries=257)
