"""Delaunay triangulation of samples that are larger than a task, in overlapping strips.

A sample's points, ranked along an axis, are cut into strips of even size. Each strip is triangulated with its neighbour on either side, and a triangle stays
if its circle lies within what these hold and no fourth point is on it: then it is a triangle of the whole mesh, and of every mesh of these points. A point
whose triangles close a ring has all of its triangles. The others (near the hull, and where circles are wide) are triangulated again
without the closed ones, along the other axis and in strips twice as large, until one task holds what is left. Among these faces, the ones
inside what stays already are told by the sides of its border: an orientation for each border side, carried over components of faces.

Points that are all on common circles (a lattice) close no ring, so they end in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meshloom.operators.delaunay import orient, triangulate
from meshloom.operators.graph import connected_components, ranked
from meshloom.plans.storage import drop_table, materialize

CORNERS = ("a", "b", "c")
#: A strip has this many times the root of its sample's points at least, or it would be narrower than most circles and no triangle would stay.
WIDE = 4


def circles(p: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each face's circle: the centre's first coordinate, the radius, and a bound on the error of both (infinite where the corners are nearly on a line)."""
    a, b, c = (p[faces[:, k]] for k in range(3))
    b, c = b - a, c - a
    left, right = b[:, 0] * c[:, 1], b[:, 1] * c[:, 0]
    d, bb, cc = 2 * (left - right), (b * b).sum(axis=1), (c * c).sum(axis=1)
    with np.errstate(all="ignore"):
        x, y = (c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d
        spread = (np.abs(c) * bb[:, None] + np.abs(b) * cc[:, None]).sum(axis=1) / np.abs(d)
        # differences of coordinates carry an error as well, relative to the coordinates
        size = np.abs(p[faces]).max(axis=(1, 2)) / np.sqrt(np.maximum(np.minimum(bb, cc), 1e-300))
        error = 1e-14 * (1 + size) * spread * (1 + (np.abs(left) + np.abs(right)) / np.abs(d)) + 1e-14 * np.abs(a[:, 0])
        radius = np.hypot(x, y)
    bad = ~np.isfinite(error + radius + x)
    return np.where(bad, 0.0, a[:, 0] + x), np.where(bad, np.inf, radius), np.where(bad, np.inf, error)


def shared_circles(p: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Faces with the opposite corner of a neighbour on their circle, or too near to tell."""
    sides = np.concatenate([faces[:, [0, 1, 2]], faces[:, [0, 2, 1]], faces[:, [1, 2, 0]]])
    face = np.tile(np.arange(len(faces)), 3)
    order = np.lexsort((sides[:, 1], sides[:, 0]))
    sides, face = sides[order], face[order]
    both = np.flatnonzero((sides[1:, :2] == sides[:-1, :2]).all(axis=1))
    q = p[sides[both + 1, 2]]
    rows = [p[sides[both, k]] - q for k in range(3)]
    lift = [(r * r).sum(axis=1) for r in rows]
    det, size = np.zeros(len(both)), np.zeros(len(both))
    for k in range(3):
        u, v = rows[k - 2], rows[k - 1]
        det += lift[k] * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        size += lift[k] * (np.abs(u[:, 0] * v[:, 1]) + np.abs(u[:, 1] * v[:, 0]))
    near = np.abs(det) <= 1e-13 * size
    out = np.zeros(len(faces), bool)
    out[face[both[near]]] = out[face[both[near] + 1]] = True
    return out


def faces_schema(points: DataFrame) -> T.StructType:
    """sample, corners a < b < c, their places, and whether they turn left (1) or right (-1)."""
    kinds = {f.name: f.dataType for f in points.schema}
    corners = [T.StructField(n, kinds["pt_id"]) for n in CORNERS]
    places = [T.StructField(f"{c}{n}", T.DoubleType()) for n in CORNERS for c in "xy"]
    return T.StructType([T.StructField("sample", kinds["sample"]), *corners, *places, T.StructField("turn", T.IntegerType())])


def _faces(arrow: pa.Schema, along: str | None):
    """Kernel: faces of one group's points; with an axis, those alone whose circle says that they are faces of the whole, and whose centre is in the strip."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pt_id")
        place = {c: t[c].to_numpy() for c in "xy"}
        faces = triangulate(place["x"], place["y"])
        if along and len(faces):
            p = np.stack([place[along], place["y" if along == "x" else "x"]], axis=1)
            lo, hi, begin, end = (t[c][0].as_py() for c in ("lo", "hi", "begin", "end"))
            centre, radius, error = circles(p, faces)
            inside = (centre - radius - 3 * error > lo) & (centre + radius + 3 * error < hi) & (centre >= begin) & (centre < end) & np.isfinite(radius)
            faces = faces[inside & ~shared_circles(p, faces)]
        pts = list(zip(place["x"].tolist(), place["y"].tolist(), strict=True))
        out = {"sample": pa.repeat(t["sample"][0], len(faces)), "turn": pa.array([1 if orient(pts[a], pts[b], pts[c]) > 0 else -1 for a, b, c in faces.tolist()], pa.int32())}
        out |= {n: t["pt_id"].take(pa.array(faces[:, k])) for k, n in enumerate(CORNERS)}
        out |= {f"{c}{n}": place[c][faces[:, k]] for k, n in enumerate(CORNERS) for c in "xy"}
        return pa.table([out[n] for n in arrow.names], names=arrow.names).cast(arrow)

    return run


def whole_faces(points: DataFrame) -> DataFrame:
    """Faces of samples that fit a task each."""
    schema = faces_schema(points)
    return points.select("sample", "pt_id", "x", "y").groupBy("sample").applyInArrow(_faces(to_arrow_schema(schema), None), schema)


def width(size: int, wide: int) -> Column:
    """Points of a strip in a sample of ``n``."""
    return F.greatest(F.lit(size), F.ceil(wide * F.sqrt("n")).cast("int"))


def strip_faces(points: DataFrame, size: int, along: str, wide: int = WIDE) -> DataFrame:
    """Faces of the whole mesh that strips of ``size`` points along an axis tell for sure, each once. Strips are wider where ``wide`` times the root of the sample's points is more."""
    other = "y" if along == "x" else "x"
    counts = points.groupBy("sample").agg(F.count("*").alias("n"))  # a row a sample
    dealt = ranked(points.select("sample", "pt_id", "x", "y"), ["sample"], [along, other, "pt_id"]).join(F.broadcast(counts), "sample").withColumn("strip", F.floor((F.col("rank") - 1) / width(size, wide)).cast("long"))
    dealt = materialize(dealt.drop("rank", "n"), "strips")
    of = Window.partitionBy("sample").orderBy("strip")  # a row for each strip
    inf = F.lit(float("inf"))
    ends = dealt.groupBy("sample", "strip").agg(F.min(along).alias("low"), F.max(along).alias("high")).select(
        "sample", "strip",
        # two strips to the left or right there is more; without them the strip and its neighbours reach the end
        F.when(F.lag("low", 2).over(of).isNotNull(), F.lag("low").over(of)).otherwise(-inf).alias("lo"),
        F.when(F.lead("low", 2).over(of).isNotNull(), F.lead("high").over(of)).otherwise(inf).alias("hi"),
        F.when(F.lag("low").over(of).isNotNull(), F.col("low")).otherwise(-inf).alias("begin"),
        F.coalesce(F.lead("low").over(of), inf).alias("end"),
    )
    spread = dealt.withColumn("strip", F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)))
    schema = faces_schema(points)
    return spread.join(ends, ["sample", "strip"]).groupBy("sample", "strip").applyInArrow(_faces(to_arrow_schema(schema), along), schema)


def corners_of(faces: DataFrame) -> DataFrame:
    """(sample, pt_id, other): a row for each corner of a face and each other corner of it."""
    pair = lambda p, q: F.struct(F.col(p).alias("pt_id"), F.col(q).alias("other"))
    return faces.select("sample", F.explode(F.array(*[pair(p, q) for p in CORNERS for q in CORNERS if p != q])).alias("e")).select("sample", "e.*")


def closed_points(faces: DataFrame) -> DataFrame:
    """(sample, pt_id) of the points whose faces close a ring: each neighbour is met in two faces."""
    met = corners_of(faces).groupBy("sample", "pt_id", "other").agg(F.count("*").alias("n"))
    return met.groupBy("sample", "pt_id").agg(F.min("n").alias("n")).filter("n = 2").select("sample", "pt_id")


def sides_of(faces: DataFrame, *more: str) -> DataFrame:
    """(sample, u, v, turn, more): each face's sides, u < v, and on which of them the face lies."""
    side = lambda p, q, s: F.struct(F.col(p).alias("u"), F.col(q).alias("v"), (F.col("turn") * s).alias("turn"))
    return faces.select("sample", *more, F.explode(F.array(side("a", "b", 1), side("b", "c", 1), side("a", "c", -1))).alias("e")).select("sample", *more, "e.*")


def outside(rest: DataFrame, kept: DataFrame) -> DataFrame:
    """Faces of ``rest`` that don't lie over ``kept``, the border of which is made of sides of ``rest``."""
    border = sides_of(kept).groupBy("sample", "u", "v").agg(F.count("*").alias("n"), F.min("turn").alias("own")).filter("n = 1").drop("n")
    numbered = materialize(ranked(rest, ["sample"], list(CORNERS), "face"), "rest-faces")
    sides = materialize(sides_of(numbered, "face").join(border, ["sample", "u", "v"], "left"), "rest-sides")
    pairs = sides.filter("own IS NULL").groupBy("sample", "u", "v").agg(F.min("face").alias("f"), F.max("face").alias("g")).filter("f < g")
    parts = connected_components(pairs, "f", "g", ("sample",)).withColumnRenamed("node", "face")
    over = sides.filter("turn = own").select("sample", "face").distinct()
    part = lambda df: df.join(parts, ["sample", "face"], "left").withColumn("component", F.coalesce("component", "face"))
    return part(numbered).join(part(over).select("sample", "component").distinct(), ["sample", "component"], "left_anti").select(*rest.columns)


def triangulate_in_strips(points: DataFrame, size: int, along: str = "x", wide: int = WIDE) -> DataFrame:
    """Faces (``faces_schema``) of points (sample, pt_id, x, y) of distinct places. Samples of at most ``size`` points are a task each, others go in strips of ``size``, or of ``wide`` times the root
    of their points where that is more (for 200,000 points a task: of samples beyond two billion)."""
    several = lambda df: df.groupBy("sample").agg(F.count("*").alias("n")).filter(F.col("n") > width(size, wide)).select("sample")
    if several(points).isEmpty():
        return whole_faces(points)
    points = materialize(points.select("sample", "pt_id", "x", "y"), "open-points")
    large = several(points)
    small = whole_faces(points.join(large, "sample", "left_anti"))
    big = points.join(large, "sample", "left_semi")
    kept = materialize(strip_faces(big, size, along, wide), "strip-faces")
    left = big.join(closed_points(kept), ["sample", "pt_id"], "left_anti")
    rest = materialize(triangulate_in_strips(left, 2 * size, "y" if along == "x" else "x", 2 * wide), "open-faces")
    out = materialize(small.unionByName(kept).unionByName(outside(rest, kept)), "faces")
    for df in (points, kept, rest):
        drop_table(df)
    return out
