"""Triangulation in strips against that of whole samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import mesh, strips
from meshloom.operators.delaunay import in_circle, orient
from meshloom.operators.delaunay import triangulate
from meshloom.plans.storage import materialize
from meshloom.sources.tables import cells as cells_of


def points(spark, samples):
    rows = [(s, i + 1, float(x), float(y)) for s, pts in samples.items() for i, (x, y) in enumerate(pts)]
    return materialize(spark.createDataFrame(rows, "sample string, pt_id long, x double, y double"), "test-points")


def faces(df):
    got = [(r.sample, r.a, r.b, r.c) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def whole(samples):
    return {(s, *(int(i) + 1 for i in f)) for s, pts in samples.items() for f in triangulate(np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float))}


@pytest.fixture(scope="module")
def samples():
    r = np.random.default_rng(5)
    around = np.linspace(0, 2 * np.pi, 150, endpoint=False)
    return {
        "even": r.random((900, 2)),
        "clusters": np.concatenate([r.normal(c, s, (150, 2)) for c, s in ((0, 1), (30, 0.1), (3, 4))]),
        "flat": np.stack([r.random(300) * 100, r.normal(0, 1e-6, 300)], axis=1),
        "tall": np.stack([np.repeat(np.arange(3.0), 100), r.random(300)], axis=1) + r.random((300, 1)) * 1e-3,
        "hollow": np.stack([np.cos(around), np.sin(around)], axis=1) * (5 + r.random((150, 1))),
        "far": r.random((250, 2)) + 1e6,
        "few": r.random((5, 2)),
    }


@pytest.mark.parametrize("size", [7, 40, 130, 400])
def test_any_width_gives_the_whole_mesh(spark, samples, size):
    assert faces(mesh.delaunay(points(spark, samples), size)) == whole(samples)


def test_most_points_close_in_strips(spark, samples):
    """What is triangulated again is the hull and its surroundings, not the sample."""
    p = points(spark, {"even": samples["even"]})
    kept = materialize(strips.strip_faces(p, 150, "x"), "test-kept")
    assert faces(kept) <= whole({"even": samples["even"]})
    assert strips.closed_points(kept).count() > 700


def test_lattices_copies_and_lines(spark):
    """Where diagonals are free the mesh is some Delaunay mesh: empty circles, the whole area, no face twice. Copies of a point stay out; a line has no face."""
    grid = [(x, y) for x in range(9) for y in range(7)]
    got = faces(mesh.delaunay(points(spark, {"grid": grid + grid[:20], "line": [(i, 2 * i) for i in range(40)]}), 10))
    assert {f[0] for f in got} == {"grid"} and len(got) == 2 * 8 * 6 and max(max(f[1:]) for f in got) <= len(grid)
    area = 0.0
    for _, *f in got:
        a, b, c = (grid[i - 1] for i in f)
        a, b, c = (a, b, c) if orient(a, b, c) > 0 else (a, c, b)
        area += orient(a, b, c) / 2
        assert all(in_circle(a, b, c, q) <= 0 for q in grid)
    assert area == 8 * 6


def test_lattice_with_a_loose_part(spark):
    """Faces on common circles beside others: both kinds meet along a border."""
    r = np.random.default_rng(8)
    pts = [(x, y) for x in range(8) for y in range(8)] + [tuple(v) for v in r.random((150, 2)) * 20 + (8, -6)]
    got = faces(mesh.delaunay(points(spark, {"s": pts}), 30))
    want = whole({"s": pts})
    assert len(got) == len(want)
    area = lambda fs: sum(abs(orient(*(pts[i - 1] for i in f[1:]))) for f in fs)
    assert area(got) == pytest.approx(area(want))
    for _, *f in got:
        a, b, c = (pts[i - 1] for i in f)
        a, b, c = (a, b, c) if orient(a, b, c) > 0 else (a, c, b)
        assert all(in_circle(a, b, c, q) <= 0 for q in pts)


def test_empty(spark):
    assert not faces(mesh.delaunay(points(spark, {"a": [(0, 0)]}).filter(F.lit(False)), 5))


def test_a_table_s_samples(spark):
    p = mesh.points_of(cells_of(spark, "/root/testdata/sf0.01"))
    assert faces(mesh.delaunay(p, 15)) == faces(mesh.delaunay(p))


def test_narrow_strips_are_widened(spark):
    """Strips of 20 points are narrower than circles of a sample of 2,500, and would close no ring."""
    p = points(spark, {"s": np.random.default_rng(5).random((2500, 2))})
    assert strips.closed_points(materialize(strips.strip_faces(p, 20, "x"), "test-kept")).count() > 1250
