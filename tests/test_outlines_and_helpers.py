"""Outlines with holes and pinches, tables of several runs, given merging scores, sub-clusters from counts, neighbour graphs."""

import random
import struct

import numpy as np
import pytest

from meshloom.operators import analysis, merge, tiles
from meshloom.plans import pipeline


def square(x, y, side, turn=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    ring = [(float(a), float(b)) for a, b in (ring[::-1] if turn else ring)]
    return [(*p, *q) for p, q in zip(ring, [*ring[1:], ring[0]])]


def read_polygons(wkb):
    kind, n = struct.unpack_from("<II", wkb, 1)
    assert kind == 6
    at, out = 9, []
    for _ in range(n):
        rings = []
        (k,) = struct.unpack_from("<I", wkb, at + 5)
        at += 9
        for _ in range(k):
            (m,) = struct.unpack_from("<I", wkb, at)
            rings.append([struct.unpack_from("<dd", wkb, at + 4 + 16 * i) for i in range(m)])
            at += 4 + 16 * m
        out.append(rings)
    assert at == len(wkb)
    return out


def test_holes_lie_in_their_own_ring():
    """The smaller outer ring has a hole, and so has an island in the greater one's hole."""
    pieces = square(0, 0, 20) + square(5, 5, 10, True) + square(6, 6, 8) + square(8, 8, 2, True) + square(30, 0, 4) + square(31, 1, 1, True)
    random.Random(1).shuffle(pieces)
    got = read_polygons(tiles.polygon_wkb(tiles.walk_rings(pieces)))
    areas = sorted([tiles.ring_area(r) for r in p] for p in got)
    assert areas == [[16.0, -1.0], [64.0, -4.0], [400.0, -100.0]]


def test_rings_are_cut_where_they_touch_themselves():
    """Two squares that share a corner, and a hole that touches its outer ring at a corner."""
    rings = tiles.walk_rings(square(0, 0, 2) + square(2, 2, 3))
    assert sorted(tiles.ring_area(r) for r in rings) == [4.0, 9.0]
    outer, hole = [(0, 0), (6, 0), (6, 6), (0, 6)], [(0, 0), (1, 3), (3, 1)]
    segments = [(*map(float, p), *map(float, q)) for ring in (outer, hole) for p, q in zip(ring, [*ring[1:], ring[0]])]
    got = read_polygons(tiles.polygon_wkb(tiles.walk_rings(segments)))
    assert [[tiles.ring_area(r) for r in p] for p in got] == [[36.0, -4.0]]
    for ring in rings:
        assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1


def test_open_segments_and_no_area():
    assert tiles.polygon_wkb([]) == struct.pack("<BII", 1, 6, 0)
    assert tiles.walk_rings([(0.0, 0.0, 1.0, 0.0)]) == [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]
    assert read_polygons(tiles.polygon_wkb(tiles.walk_rings([(0.0, 0.0, 1.0, 0.0)]))) == []


def test_bound_objects(spark):
    t = spark.createDataFrame([("s", 1, 5)], "sample string, tile_id long, npts long")
    e = spark.createDataFrame([("s", 1, 2)], "sample string, from_tile long, to_tile long")
    p = spark.createDataFrame([("s", 9, None)], "sample string, pt_id long, tile_id long")
    out = pipeline.bind_objects({"a": {"tiles": t, "tile_edges": e}, "b": {"tiles": t.drop("npts"), "points": p, "cell_adjacency": p.selectExpr("sample", "pt_id AS a", "pt_id AS b")}})
    assert {(r.object, r.tile_id, r.npts) for r in out["tiles"].collect()} == {("a", "a_s_1", 5), ("b", "b_s_1", None)}
    assert [(r.from_tile, r.to_tile) for r in out["tile_edges"].collect()] == [("a_s_1", "a_s_2")]
    assert [r.tile_id for r in out["points"].collect()] == [None]
    assert [r.a for r in out["cell_adjacency"].collect()] == [9]


def test_merging_by_given_scores(spark):
    """A path of five tiles: the edge of 0.9 first, then that of 0.5; a negative score never."""
    rows = [(0, i, 1, 1.0, 4.0, [float(i)]) for i in range(1, 6)]
    t = spark.createDataFrame(rows, "sample int, tile_id long, npts long, area double, perimeter double, emb array<double>")
    e = spark.createDataFrame([(0, 1, 2, 1.0, 0.5), (0, 2, 3, 1.0, 0.9), (0, 3, 4, 1.0, -0.1), (0, 4, 5, 1.0, 0.0)], "sample int, from_tile long, to_tile long, edge_length double, dscore double")
    scored = merge.scores(e, t, None, 1, merge.STATIC)
    assert {r.w for r in scored.collect()} == {0.0}
    mapping, kept, _ = merge.merge_tiles(t, scored, None, merge.STATIC)
    assert {r.tile_id: r.new_id for r in mapping.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    assert {r.tile_id: (r.npts, r.area, r.perimeter, [round(v, 9) for v in r.emb]) for r in kept.collect()} == {1: (3, 3.0, 8.0, [2.0]), 2: (2, 2.0, 6.0, [4.5])}
    with pytest.raises(ValueError):
        merge.scores(e.drop("dscore"), t, None, 1, merge.STATIC)


def test_subclusters_of_counts(spark):
    """Two kinds of cells with genes of their own within a cluster are told apart; a cell without counts and other clusters stay."""
    r = random.Random(2)
    cells = [(i, "x" if i < 41 else "y") for i in range(60)]
    counts = [(i, f"g{g}", float(r.randrange(20, 40) if (g < 5) == (i % 2 == 0) else r.randrange(1, 4))) for i in range(60) if i != 40 for g in range(10)]
    c, n = spark.createDataFrame(cells, "cell_id long, label string"), spark.createDataFrame(counts, "cell_id long, gene string, count double")
    got = {x.cell_id: x.label for x in analysis.subcluster_counts(c, n, "x", "label", 8, 3, 10).collect()}
    assert len(got) == 60 and got[40] == "x_-1"
    assert {got[i] for i in range(0, 40, 2)}.isdisjoint(got[i] for i in range(1, 40, 2))
    assert {got[i] for i in range(41, 60)} == {"y"}


def test_neighbours_and_memberships_against_loops(spark):
    """Ties go to the smaller id; each list's memberships sum to the logarithm of its length."""
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (40, 3)).astype(float) + 0.25
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, emb array<double>")
    near = analysis.knn(df, 6, block=16)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(40):
        d = np.round(1 - u @ u[i], 12)
        want = sorted((round(d[j], 9), j) for j in range(40) if j != i)[:6]
        got = sorted((round(x.distance, 9), x.other) for x in near.filter(f"id = {i}").collect()) if i in (0, 17) else want
        assert got == want
    one = {}
    for x in near.collect():
        one.setdefault(x.id, []).append((x.other, x.distance))
    member = {}
    for i, l in one.items():
        d = np.array([x for _, x in l])
        rho = d[d > 0].min() if (d > 0).any() else 0.0
        low, high, sigma = 0.0, np.inf, 1.0
        for _ in range(64):
            s = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(s - np.log2(len(d))) < 1e-5:
                break
            low, high = (low, sigma) if s > np.log2(len(d)) else (sigma, high)
            sigma = (low + high) / 2 if np.isfinite(high) else sigma * 2
        sigma = max(sigma, 1e-3 * d.mean(), 1e-12)
        member |= {(i, o): np.exp(-max(x - rho, 0) / sigma) for o, x in l}
    for x in analysis.fuzzy_graph(near).collect():
        a, b = member.get((x.id, x.other), 0.0), member.get((x.other, x.id), 0.0)
        assert abs(x.weight - (a + b - a * b)) < 1e-9
