"""The additive quality model: held-out ranking, pairs, bounds and odd rows."""

import zlib

import duckdb
import numpy as np
import pytest

from meshloom.llm import quality_gam as q
from meshloom.llm import queries

SF = "/root/testdata/sf0.01"


def auc(score, y):
    one, two = score[y == 1], score[y == 0]
    return float(np.mean((one[:, None] > two) + 0.5 * (one[:, None] == two)))


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op11_quality_gam(spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels if got[i].held_out]
    s, y = np.array(held).T
    assert auc(s, y) > 0.97 and ((s >= 0.3) == y).mean() > 0.95


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(2)
    x = r.random((3000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    with_pairs, without = q.Model(x, y), q.Model(x, y, pairs=0)
    fresh = r.random((1000, 5))
    truth = ((fresh[:, 1] > 0.5) ^ (fresh[:, 3] > 0.5)).astype(int)
    assert (3, 1) in with_pairs.pairs and auc(with_pairs.scores(fresh), truth) > 0.98 and auc(without.scores(fresh), truth) < 0.6


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(3)
    x = np.round(r.random((800, 4)), 1)
    m = q.Model(x, (x[:, 0] + x[:, 2] * x[:, 3] > 0.8).astype(int))
    for row, score in zip(x[:50], m.scores(x[:50]), strict=True):
        z = m.base + sum(t[np.sum(c < v)] for v, c, t in zip(row, m.cuts, m.tables, strict=True))
        z += sum(t[np.sum(m.coarse[a] < row[a]), np.sum(m.coarse[b] < row[b])] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_features_do_not_hang_on_neighbours():
    texts = ["Plain words here, and more of them.", None, "", "!!! BUY *** now*** now***\n| a | b |", "\n", "é", "ünï çödé ÄÖ", "x" * 50_000, "word " * 30_000]
    every = q.features(texts)
    assert np.isfinite(every).all() and every.shape == (len(texts), len(q.FEATURES))
    assert all((q.features([t])[0] == row).all() for t, row in zip(texts, every, strict=True)) and (every[1] == every[2]).all()
    f = dict(zip(q.FEATURES, every[3], strict=True))
    assert f["bar_share"] == 3 / 35 and f["shout_share"] == 3 / 35 and f["sign_end_share"] == 7 / 10 and f["shouted_share"] == 1 / 10
    assert q.features([]).shape == (0, len(q.FEATURES))


def test_a_hot_id_stays_one_row_of_the_sample(spark):
    docs = [(7, f"hot text {i}") for i in range(500)] + [(i, f"good words number {i} are here") for i in range(100, 160)] + [(None, "x"), (8, None)]
    labels = [(7, 1)] * 300 + [(7, 0), (None, 1), (8, None), (9, 3)] + [(i, i % 2) for i in range(100, 160)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    x, found = q.sample_of(d, y, q.fold("id", 1) == 0)
    assert len(x) == 62 and sorted(found.tolist()).count(1) == 31
    assert len(q.sample_of(d, y, q.fold("id", 1) == 0, sample=10)[0]) == 10


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "a"), (2, "", 2, "b"), (None, "some text", 3, "c"), (2, "", 2, "b")], "doc_id long, text string, score int, id string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.score_documents(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got) and [r.held_out for r in got if r.id is None] == [False]
    one = q.score_documents(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert q.score_documents(docs.limit(0), none).collect() == []
