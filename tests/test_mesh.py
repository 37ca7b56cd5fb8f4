import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.operators import mesh
from meshloom.operators.delaunay import in_circle, orient, triangulate

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=0, max_size=20), st.booleans())
def test_triangulation_is_delaunay(points, shift):
    pts = [(x + 0.1 * y * shift, y * 1.0) for x, y in points]
    t = triangulate(np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float))
    edges = {tuple(sorted(e)) for f in t.tolist() for e in itertools.combinations(f, 2)}
    used = {i for f in t.tolist() for i in f}
    for f in t.tolist():
        a, b, c = (pts[i] for i in f)
        a, b, c = (a, b, c) if orient(a, b, c) > 0 else (a, c, b)
        assert all(in_circle(a, b, c, p) <= 0 for p in pts)
    if len(t):
        assert len(used) - len(edges) + len(t) == 1 and len(used) == len(set(pts))
    else:
        assert len(set(pts)) < 3 or all(orient(*c) == 0 for c in itertools.combinations(sorted(set(pts)), 3))


def cells(spark, samples):
    rows = [(s, i + 1, x, y, [x, y]) for s, pts in samples.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "sample string, cell_id long, x double, y double, emb array<double>")


def test_square(spark):
    m = mesh.build_mesh(cells(spark, {"a": SQUARE})).kept()
    tris = m.triangles.collect()
    assert len(tris) == 4 and all(abs(t.area - 0.25) < 1e-12 and abs(t.height - 0.5**0.5) < 1e-12 for t in tris)
    assert m.edges.count() == 8 and m.edges.filter("from_tri IS NULL").count() == 4
    x = mesh.add_exterior(m)
    assert x.triangles.count() == 8 and x.edges.filter("boundary").count() == 4
    assert x.edges.filter("from_tri IS NULL OR to_tri IS NULL").count() == 0
    assert x.tri_vertex.count() == 4 * 3 + 4 * 2


@pytest.mark.parametrize(("mincells", "left"), [(5, 10), (6, 0)])
def test_two_blobs(spark, mincells, left):
    m = mesh.build_mesh(cells(spark, {"a": SQUARE + [(x + 100, y + 0.3) for x, y in SQUARE]})).kept()
    p = mesh.prune(m, thresh=2.0, mincells=mincells)
    assert p.points.count() == left
    assert p.triangles.count() == (8 if left else 0)
    assert p.edges.filter("to_tri IS NULL").count() == 0


def test_degenerate_samples(spark):
    rows = [("line", i, float(i), 0.0) for i in range(4)] + [("copies", i, 1.0, 1.0) for i in range(3)] + [(None, 9, 0.0, 0.0), ("x", None, 0.0, 0.0), ("x", 1, None, 0.0)]
    m = mesh.build_mesh(spark.createDataFrame(rows, "sample string, cell_id long, x double, y double")).kept()
    assert m.triangles.count() == 0 and m.edges.count() == 0 and m.points.count() == 7
    assert mesh.add_exterior(m).triangles.count() == 0


def test_missing_metadata_is_an_error(spark):
    with pytest.raises(ValueError, match="colour"):
        mesh.build_mesh(cells(spark, {"a": SQUARE}), "colour")
