"""Near-duplicate vectors with many links: the query against its SQL, and planted pairs through the whole operator."""

import collections

import duckdb
import numpy as np
import pytest

from meshloom.llm import hnsw, queries


def clusters(seed=3, n=400, d=24):
    """Vectors of three labels with chains, clusters, copies, lone pairs and odd rows."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for a, size, noise in ((0, 40, 0.15), (50, 25, 0.3), (90, 10, 0.0), (120, 6, 0.2)):
        x[a + 1 : a + size] = x[a] + r.normal(0, noise, (size - 1, d)) if noise else x[a]
    for i in range(150, 190):  # a chain whose ends aren't linked
        x[i + 1] = x[i] + r.normal(0, 0.28, d)
    rows = [(i, x[i].tolist(), int(i % 2) if i < 130 else 2) for i in range(n)]
    return rows + [(1000, None, 0), (1001, [0.0] * d, 0), (1002, x[0].tolist(), None), (1003, [None] * d, 1)]


def test_query_against_its_sql(spark, tmp_path):
    spark.createDataFrame(clusters(), "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.NEAR_DUP_SQL})").fetchall()
    got = queries.op1_hnsw_near_dup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_links > 0 for r in got) > 100 and max(r.n_links for r in got) > 9


@pytest.mark.parametrize(("dims", "shard"), [(64, 1500), (256, 1500), (64, 16_384)])
def test_planted_pairs(spark, dims, shard):
    r = np.random.default_rng(dims)
    n, pairs = 4000, 60
    x = r.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = r.permutation(n)[: 2 * pairs].reshape(2, -1)
    away = r.normal(size=(pairs, dims))
    away -= np.einsum("kd,kd->k", away, x[at[0]])[:, None] * x[at[0]]
    c = r.uniform(0.935, 0.96, (pairs, 1))
    x[at[1]] = c * x[at[0]] + np.sqrt(1 - c * c) * away / np.linalg.norm(away, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = hnsw.near_duplicates(df, shard=shard).collect()
    links = collections.Counter({r.id: r.n_links for r in got})
    found = sum(links[a] == links[b] == 1 for a, b in at.T.tolist())
    assert found >= 0.99 * pairs and sum(links.values()) <= 2 * pairs
    assert all(r.component == min(a, b) for a, b in at.T.tolist() for r in got if r.id in (a, b) and r.n_links)


def test_a_link_found_from_one_end_counts_at_both():
    links = hnsw.Links(5)
    links.add(np.array([0, 3]), np.array([4, 1]))
    assert links.weights(np.array([1, 2, 1, 1, 3])).tolist() == [3, 1, 0, 2, 1]
