import math
import random

import numpy as np
import pytest

from meshloom.operators import merge, morse, tiles
from meshloom.plans import pipeline
from meshloom.sources import tables

SF = "/root/testdata/sf0.001"


def naive_forest(nf, edges):
    """Edges in descending f, ties by id: labels spread from the first edge of each tree."""
    label, parent, via, saddles = {}, {}, {}, []
    for k, a, b, _ in sorted(edges, key=lambda e: (-e[3], e[0])):
        if a not in label and b not in label:
            root, leaf = (a, b) if nf[a] > nf[b] else (b, a)
            label[root] = label[leaf] = root
            parent[root], parent[leaf], via[root], via[leaf] = None, root, None, k
        elif a not in label or b not in label:
            new, old = (a, b) if a not in label else (b, a)
            label[new], parent[new], via[new] = label[old], old, k
        elif label[a] != label[b]:
            saddles.append(k)
    return label, parent, via, saddles


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_against_one_edge_at_a_time(spark, seed):
    r = random.Random(seed)
    nf = {i: float(r.randrange(6) if seed == 2 else r.random()) for i in range(30)}
    pairs = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(60)})
    edges = [(k + 1, a, b, float(r.randrange(5) if seed == 2 else r.random())) for k, (a, b) in enumerate(pairs)]
    n = spark.createDataFrame([(0, i, f) for i, f in nf.items()], "sample int, node long, f double")
    e = spark.createDataFrame([(0, *x) for x in edges], "sample int, edge_id long, a long, b long, f double")
    tree = morse.forest(n, e)
    label, parent, via, saddles = naive_forest(nf, edges)
    assert {x.node: (x.root, x.parent, x.parent_edge) for x in tree.collect()} == {v: (label[v], parent[v], via[v]) for v in label}
    assert sorted(x.edge_id for x in morse.saddles(tree, e, "a", "b").collect()) == sorted(saddles)


def test_path_forest(spark):
    n = spark.createDataFrame([(0, 1, 9.0), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 9.0)], "sample int, node long, f double")
    e = spark.createDataFrame([(0, 1, 1, 2, 3.0), (0, 2, 2, 3, 1.0), (0, 3, 3, 4, 2.0)], "sample int, edge_id long, a long, b long, f double")
    tree = morse.forest(n, e)
    assert {r.node for r in morse.critical_nodes(tree).collect()} == {1, 4}
    assert [r.edge_id for r in morse.saddles(tree, e, "a", "b").collect()] == [2]


def naive_merge(npts, area, per, emb, ends, length, mode, mu, sig, max_npts, min_npts, dscore, emb_m):
    """The rules as plain loops over all edges."""
    npts, area, per, emb, ends, length, s = list(npts), list(area), list(per), [np.array(e) for e in emb], [list(e) for e in ends], list(length), list(dscore)
    emb_m, group = [np.array(e) for e in emb_m], [[i] for i in range(len(npts))]
    for _ in range(len(npts) - 1):
        i = max(range(len(s)), key=lambda k: (s[k], -k))
        if s[i] < 0:
            break
        a, b = ends[i]
        s[i] = -math.inf
        group[a], group[b] = group[a] + group[b], []
        emb[a], area[a], npts[a], per[a] = emb_m[i], area[a] + area[b], npts[a] + npts[b], per[a] + per[b] - 2 * length[i]
        for e in ends:
            e[:] = [a if x == b else x for x in e]
        mine = [k for side in (0, 1) for k in range(len(ends)) if s[k] != -math.inf and ends[k][side] == a]
        first = {}
        for k in mine:
            o = ends[k][1] if ends[k][0] == a else ends[k][0]
            if o in first:
                length[first[o]] += length[k]
                s[k] = -math.inf
            else:
                first[o] = k
        for k in first.values():
            p, q = ends[k]
            n = npts[p] + npts[q]
            emb_m[k] = (npts[p] * emb[p] + npts[q] * emb[q]) / n
            w = (0.5 if mode == 2 else 1) - 1 / (1 + math.exp(-(np.linalg.norm(emb[p] - emb[q]) - mu) / sig))
            c = lambda ar, pe: 4 * math.pi * ar / pe**2
            dc = 0.5 * (c(area[p] + area[q], per[p] + per[q] - 2 * length[k]) - npts[p] / n * c(area[p], per[p]) - npts[q] / n * c(area[q], per[q]) + 1)
            out = n >= max_npts if mode == 2 else npts[p] >= min_npts and npts[q] >= min_npts
            s[k] = -1.0 if out else w * (1 - npts[p] / max_npts) * (1 - npts[q] / max_npts) * dc
    return sorted(sorted(g) for g in group if g)


@pytest.mark.parametrize("mode", [2, 3])
def test_merging_against_plain_loops(mode):
    for seed in range(12):
        r = np.random.default_rng(seed)
        k = 5
        at = lambda i, j: i * k + j
        ends = [(at(i, j), at(i, j + 1)) for i in range(k) for j in range(k - 1)] + [(at(i, j), at(i + 1, j)) for i in range(k - 1) for j in range(k)]
        n = k * k
        npts, area, per, emb = r.integers(1, 6, n).astype(float), r.uniform(1, 2, n), r.uniform(4, 6, n), r.normal(0, 1, (n, 3))
        length, size = r.uniform(0.3, 1, len(ends)), 12.0 if mode == 2 else math.inf
        m = merge.Agglomerator(npts, area, per, emb, ends, length, np.zeros(len(ends)), np.ones(len(ends)), np.zeros(len(ends)), np.zeros(len(ends)), np.zeros((len(ends), 3)), 1.5, 0.5, mode, 4, size)
        for e in range(len(ends)):
            m._score(e)
        args = (npts, area, per, emb, ends, length, mode, 1.5, 0.5, size, 4, m.dscore.copy(), m.emb_merged.copy())
        assert sorted(sorted(g) for g in m.run().group if g) == naive_merge(*args)


def test_mixture():
    r = np.random.default_rng(0)
    mean, sd = merge.fit_mixture(np.concatenate([r.normal(1, 0.2, 400), r.normal(5, 0.5, 300)]))
    assert abs(mean - 1) < 0.05 and 0.1 < sd < 0.5
    assert merge.fit_mixture(np.array([2.0, 2.0, 2.0, 2.0])) == (2.0, 1.0)
    assert merge.fit_mixture(np.array([])) == (0.0, 1.0)


def test_rings():
    square = [(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0)]
    hole = [(0.5, 0.5, 0.5, 1), (0.5, 1, 1, 1), (1, 1, 1, 0.5), (1, 0.5, 0.5, 0.5)]
    rings = tiles.walk_rings(square + hole)
    assert sorted(round(tiles.ring_area(r), 6) for r in rings) == [-0.25, 4.0]
    assert tiles.polygon_wkb(rings)[:9] == b"\x01\x06\x00\x00\x00\x01\x00\x00\x00"


def test_pipeline_invariants(spark):
    cells = tables.cells(spark, SF, 8)
    out = pipeline.get_tiles(cells, 8, options=pipeline.Options(max_npts=15, min_npts=3))
    t = out["tiles"].collect()
    points = out["points"].count()
    assert sum(r.npts for r in t) == points == cells.count()
    grown = out["points"].groupBy("sample", "tile_id").count().collect()
    assert {(r["sample"], r["tile_id"]): r["count"] for r in grown} == {(r.sample, r.tile_id): r.npts for r in t}
    areas = {r["sample"]: 0.0 for r in grown}
    for r in t:
        areas[r.sample] += r.area
    from meshloom.operators.mesh import build_mesh

    whole = {r["sample"]: r["a"] for r in pipeline.prepare_mesh(cells, pipeline.Options()).triangles.selectExpr("sample", "area").groupBy("sample").agg({"area": "sum"}).withColumnRenamed("sum(area)", "a").collect()}
    assert all(abs(areas[s] - whole[s]) < 1e-9 for s in whole)
    assert build_mesh(cells).points.count() == points
    ids = pipeline.check_unique(pipeline.consolidate(out["tiles"], "tile_id"), "tile_id")
    assert ids.filter("tile_id LIKE '%\\\\_%'").count() == len(t)
    pts, more = pipeline.add_isolated(cells.union(cells.limit(1).selectExpr("sample", "-5L", "9.0D", "9.0D", "emb")), out["points"], out["tiles"], 16)
    assert more.count() == len(t) + 1 and pts.count() == points + 1
    assert more.filter("npts = 1 AND area IS NULL").first().emb is not None


def test_loose_ends_against_a_loop(spark):
    """Random graphs of triangles: edges that end alone in an inner triangle go, one at a time, until none is left."""
    r = np.random.default_rng(8)
    edges, outer, want = [], [], set()
    for sample in range(4):
        links = {(int(a), int(b)) for a, b in r.integers(0, 40, (45, 2)) if a < b}
        own = [(sample, i, a, b) for i, (a, b) in enumerate(sorted(links))]
        sep = [e for e in own if e[1] % 9]
        edges += own
        outside = set(r.choice(40, 6, replace=False).tolist())
        outer += [(sample, t) for t in outside]
        left = {e[1]: e[2:] for e in sep}
        while loose := [i for i, ends in left.items() if any(t not in outside and sum(t in o for o in left.values()) == 1 for t in ends)]:
            del left[loose[0]]
        want |= {(sample, i) for i in left}
    df = spark.createDataFrame(edges, "sample int, edge_id long, from_tri long, to_tri long")
    got = morse.prune_separatrices(df, df.filter("edge_id % 9 <> 0").select("sample", "edge_id"), spark.createDataFrame(outer, "sample int, tri_id long"))
    assert {tuple(x) for x in got.collect()} == want and 0 < len(want) < len(edges)
