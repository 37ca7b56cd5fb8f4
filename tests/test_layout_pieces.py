"""Rounds of the layout: edges are packed once, a row a piece, and nodes' places alone move."""

import numpy as np
from pyspark.sql import functions as F

from meshloom.operators import layout


def test_sums_of_neighbours_over_pieces(spark):
    """A hub in two pieces, named by text; against sums edge by edge."""
    r = np.random.default_rng(0)
    pairs = {(0, j) for j in range(1, 200)} | {(int(a), int(b)) for a, b in r.integers(0, 200, (600, 2)) if a != b}
    edges = [(a, b, float(1 + (a * b) % 7)) for x, y in pairs for a, b in ((x, y), (y, x))]
    edges = sorted({(a, b): (a, b, w) for a, b, w in edges}.values())
    place = r.normal(size=(200, 2))
    dealt = spark.createDataFrame([(a % 3, b % 2 if a == 0 else 0, f"n{a}", f"n{b}", w) for a, b, w in edges], "block long, piece long, node string, other string, w double").repartition(5)
    rows, homes = layout.packed(dealt)
    assert rows.count() == 4 and homes.count() == 200
    now = spark.createDataFrame([(f"n{i}", [float(v) for v in p]) for i, p in enumerate(place)], "node string, at array<double>").repartition(3)
    got = layout.in_pieces(now, rows, homes, 3, layout.pulled, "string", "at array<double>, sums array<double>").collect()
    assert len(got) == 201 and sum(x.node == "n0" for x in got) == 2
    want, found = np.zeros((200, 3)), np.zeros((200, 3))
    for a, b, w in edges:
        want[a] += [*place[b] * w, w]
    for x in got:
        found[int(x.node[1:])] += x.sums
        assert np.allclose(x.at, place[int(x.node[1:])])
    assert np.allclose(found, want)


def test_an_end_without_edges_of_its_own(spark):
    """An end that no edge starts from has no place; the others are laid out."""
    rows = [(a, b, 1.0) for a in range(30) for b in (a - 1, a + 1) if 0 <= b < 30] + [(3, 99, 1.0)]
    got = layout.umap(spark.createDataFrame(rows, "id long, other long, weight double"), epochs=20, rounds=2, start_rounds=3, block=7).select("id", F.col("at")).collect()
    assert sorted(r.id for r in got) == list(range(30)) and np.isfinite([r.at for r in got]).all()
