"""Triangle meshes over the cells of each sample: construction, pruning, the ring of outer triangles.

Ids are explicit: ``pt_id`` is the cell's id, ``tri_id`` and ``edge_id`` count from 1 within a sample, triangles by their corners
and edges by their ends. Everything but the triangulation itself, which needs a sample's points together, is relational.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.graph import connected_components, symmetric
from meshloom.operators.strips import triangulate_in_strips
from meshloom.plans.storage import materialize, materialize_all

#: Points that a task triangulates at once: about 12 seconds and 200 MB.
TASK = 200_000


@dataclass(frozen=True)
class Mesh:
    """points(sample, pt_id, x, y, ...), triangles(sample, tri_id, x, y, area, height, external), tri_vertex(sample, tri_id, pt_id), edges(14 columns)."""

    points: DataFrame
    triangles: DataFrame
    tri_vertex: DataFrame
    edges: DataFrame

    def kept(self) -> Mesh:
        """The same mesh with its tables written, so that what reads them many times computes them once."""
        return Mesh(*materialize_all({n: getattr(self, n) for n in ("points", "triangles", "tri_vertex", "edges")}))


def points_of(cells: DataFrame, *meta: str) -> DataFrame:
    """Cells with a place, as points; ``meta`` are further columns to keep. A null sample, id or coordinate drops the row."""
    missing = [c for c in meta if c not in cells.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    rows = cells.filter("sample IS NOT NULL AND cell_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    return rows.select("sample", F.col("cell_id").alias("pt_id"), "x", "y", *meta)


def delaunay(points: DataFrame, task: int = TASK) -> DataFrame:
    """(sample, a, b, c, with each corner's place): triangles with a < b < c. A sample of more than ``task`` points is triangulated in strips of as many.

    Of points at one place, that of the least id is in the mesh.
    """
    apart = points.groupBy("sample", "x", "y").agg(F.min("pt_id").alias("pt_id"))
    return triangulate_in_strips(apart, task).drop("turn")


def triangle_table(faces: DataFrame) -> DataFrame:
    """Faces with their id, centroid, area (Heron's formula) and largest height."""
    side = lambda p, q: F.sqrt((F.col(f"x{p}") - F.col(f"x{q}")) ** 2 + (F.col(f"y{p}") - F.col(f"y{q}")) ** 2)
    df = faces.withColumns({"s1": side("a", "b"), "s2": side("b", "c"), "s3": side("a", "c")})
    half = (F.col("s1") + F.col("s2") + F.col("s3")) / 2
    area = F.sqrt(F.greatest(half * (half - F.col("s1")) * (half - F.col("s2")) * (half - F.col("s3")), F.lit(0.0)))
    df = df.withColumn("area", area).withColumn("height", 2 * F.col("area") / F.least("s1", "s2", "s3"))
    centre = [((F.col(f"{c}a") + F.col(f"{c}b") + F.col(f"{c}c")) / 3).alias(c) for c in "xy"]
    tri_id = F.row_number().over(Window.partitionBy("sample").orderBy("a", "b", "c")).cast("long")
    return df.select("sample", tri_id.alias("tri_id"), *centre, "area", "height", F.lit(False).alias("external"), "a", "b", "c", "xa", "ya", "xb", "yb", "xc", "yc")


def edge_table(tris: DataFrame) -> DataFrame:
    """Edges once each: ends, triangles (``to_tri`` alone at the hull, else ``from_tri`` < ``to_tri``), places of all and lengths."""
    pair = lambda p, q: F.struct(F.col(p).alias("from_pt"), F.col(q).alias("to_pt"), F.col(f"x{p}").alias("x0_pt"), F.col(f"x{q}").alias("x1_pt"), F.col(f"y{p}").alias("y0_pt"), F.col(f"y{q}").alias("y1_pt"))
    sides = tris.select("sample", F.struct("tri_id", "x", "y").alias("tri"), F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("e")).select("sample", "tri", "e.*")
    own = ["from_pt", "to_pt", "x0_pt", "x1_pt", "y0_pt", "y1_pt"]
    e = sides.groupBy("sample", *own).agg(F.count("*").alias("n"), F.min("tri").alias("t0"), F.max("tri").alias("t1"))
    first = lambda f: F.when(F.col("n") == 2, F.col(f"t0.{f}"))
    e = e.select("sample", *own, first("tri_id").alias("from_tri"), F.col("t1.tri_id").alias("to_tri"), first("x").alias("x0_tri"), F.col("t1.x").alias("x1_tri"), first("y").alias("y0_tri"), F.col("t1.y").alias("y1_tri"))
    length = lambda k: F.sqrt((F.col(f"x1_{k}") - F.col(f"x0_{k}")) ** 2 + (F.col(f"y1_{k}") - F.col(f"y0_{k}")) ** 2).alias(f"length_{k}")
    edge_id = F.row_number().over(Window.partitionBy("sample").orderBy("from_pt", "to_pt")).cast("long").alias("edge_id")
    return e.select("sample", edge_id, "from_pt", "to_pt", "from_tri", "to_tri", "x0_pt", "x1_pt", "y0_pt", "y1_pt", "x0_tri", "x1_tri", "y0_tri", "y1_tri", length("pt"), length("tri"))


def build_mesh(cells: DataFrame, *meta: str) -> Mesh:
    """Points, triangles, corners and edges of each sample's Delaunay triangulation; a sample off which no triangle can be made has points alone."""
    points = points_of(cells, *meta)
    full = triangle_table(materialize(delaunay(points), "faces"))
    corners = full.select("sample", "tri_id", F.explode(F.array("a", "b", "c")).alias("pt_id"))
    return Mesh(points, full.select("sample", "tri_id", "x", "y", "area", "height", "external"), corners, edge_table(full))


def incident_triangles(edges: DataFrame) -> DataFrame:
    """(sample, tri_id, edge_id, length_pt): a row for each triangle of each edge."""
    return edges.select("sample", F.explode(F.array("from_tri", "to_tri")).alias("tri_id"), "edge_id", "length_pt").filter("tri_id IS NOT NULL")


def thresholds(edges: DataFrame, quantile: float = 0.95, thresh: float | None = None) -> DataFrame:
    """(sample, thresh): the given length, or the samples' exact quantile by linear interpolation; infinite for a quantile of 1 or more."""
    if thresh is not None:
        return edges.select("sample").distinct().withColumn("thresh", F.lit(float(thresh)))
    if quantile >= 1:
        return edges.select("sample").distinct().withColumn("thresh", F.lit(float("inf")))
    return edges.groupBy("sample").agg(F.percentile("length_pt", F.lit(quantile)).alias("thresh"))


def triangles_to_keep(mesh: Mesh, quantile: float = 0.95, mincells: int = 10, thresh: float | None = None) -> DataFrame:
    """(sample, tri_id) of triangles with three short edges, in a component that has ``mincells`` points or more.

    Components join triangles over shared edges; every triangle with a long edge is one of its own. A sample that is a single
    component stays whole.
    """
    short = mesh.edges.join(F.broadcast(thresholds(mesh.edges, quantile, thresh)), "sample").filter("length_pt <= thresh")
    good = materialize(incident_triangles(short).groupBy("sample", "tri_id").agg(F.count("*").alias("n")).filter("n = 3").select("sample", "tri_id"), "short-triangles")
    dual = mesh.edges.filter("from_tri IS NOT NULL").select("sample", "from_tri", "to_tri")
    for end in ("from_tri", "to_tri"):
        dual = dual.join(good.withColumnRenamed("tri_id", end), ["sample", end], "left_semi")
    comp = connected_components(dual, "from_tri", "to_tri", ("sample",)).withColumnRenamed("node", "tri_id")
    labelled = good.join(comp, ["sample", "tri_id"], "left").withColumn("component", F.coalesce("component", "tri_id"))
    sizes = labelled.join(mesh.tri_vertex, ["sample", "tri_id"]).groupBy("sample", "component").agg(F.countDistinct("pt_id").alias("cells"))
    parts = labelled.groupBy("sample").agg(F.countDistinct("component").alias("parts"), F.count("*").alias("kept"))
    whole = mesh.triangles.groupBy("sample").agg(F.count("*").alias("total")).join(parts, "sample").filter("parts = 1 AND kept = total").select("sample", F.lit(True).alias("whole"))
    out = labelled.join(sizes, ["sample", "component"]).join(F.broadcast(whole), "sample", "left")
    return out.filter((F.col("cells") >= mincells) | F.col("whole")).select("sample", "tri_id")


def prune(mesh: Mesh, quantile: float = 0.95, mincells: int = 10, thresh: float | None = None) -> Mesh:
    """The mesh without long triangles and small components: edges of a kept triangle and points of a kept edge stay.

    Triangles and edges are numbered anew in the old order. An edge that loses ``from_tri`` or ``to_tri`` keeps the other as ``to_tri``;
    the length between its triangles stays as it was.
    """
    keep = triangles_to_keep(mesh, quantile, mincells, thresh)
    renumber = materialize(keep.select("sample", "tri_id", F.row_number().over(Window.partitionBy("sample").orderBy("tri_id")).cast("long").alias("new_id")), "kept-triangles")
    tris = mesh.triangles.join(renumber, ["sample", "tri_id"]).withColumn("tri_id", F.col("new_id")).drop("new_id").select(*mesh.triangles.columns)
    corners = mesh.tri_vertex.join(renumber, ["sample", "tri_id"]).select("sample", F.col("new_id").alias("tri_id"), "pt_id")
    e = mesh.edges
    for end in ("from", "to"):
        e = e.join(renumber.select("sample", F.col("tri_id").alias(f"{end}_tri"), F.col("new_id").alias(f"new_{end}")), ["sample", f"{end}_tri"], "left")
    e = e.filter("new_from IS NOT NULL OR new_to IS NOT NULL")
    lost = F.col("new_to").isNull()
    both = F.col("new_from").isNotNull() & F.col("new_to").isNotNull()
    moved = {
        "from_tri": F.when(both, F.col("new_from")), "to_tri": F.coalesce("new_to", "new_from"),
        "x1_tri": F.when(lost, F.col("x0_tri")).otherwise(F.col("x1_tri")), "y1_tri": F.when(lost, F.col("y0_tri")).otherwise(F.col("y1_tri")),
        "x0_tri": F.when(both, F.col("x0_tri")), "y0_tri": F.when(both, F.col("y0_tri")),
        "edge_id": F.row_number().over(Window.partitionBy("sample").orderBy("edge_id")).cast("long"),
    }
    e = e.withColumns(moved).select(*mesh.edges.columns)
    used = e.select("sample", F.explode(F.array("from_pt", "to_pt")).alias("pt_id")).distinct()
    return Mesh(mesh.points.join(used, ["sample", "pt_id"], "left_semi"), tris, corners, e)


def add_exterior(mesh: Mesh) -> Mesh:
    """A flat outer triangle for every hull edge, at its middle, so that each edge has two; edges get ``boundary``."""
    count = mesh.triangles.groupBy("sample").agg(F.max("tri_id").alias("ntri"))
    hull = mesh.edges.filter("from_tri IS NULL").join(F.broadcast(count), "sample")
    new_id = F.col("ntri") + F.row_number().over(Window.partitionBy("sample").orderBy("edge_id"))
    middle = {c: (F.col(f"{c}0_pt") + F.col(f"{c}1_pt")) / 2 for c in "xy"}
    outer = hull.select("sample", "edge_id", new_id.alias("tri_id"), middle["x"].alias("x"), middle["y"].alias("y"), "from_pt", "to_pt")
    tris = mesh.triangles.unionByName(outer.select("sample", "tri_id", "x", "y", F.lit(0.0).alias("area"), F.lit(0.0).alias("height"), F.lit(True).alias("external")))
    corners = mesh.tri_vertex.unionByName(outer.select("sample", "tri_id", F.explode(F.array("from_pt", "to_pt")).alias("pt_id")))
    e = mesh.edges.join(outer.select("sample", "edge_id", F.col("tri_id").alias("ext")), ["sample", "edge_id"], "left")
    e = e.withColumns({"boundary": F.col("ext").isNotNull(), "from_tri": F.coalesce("from_tri", "ext"), "x0_tri": F.coalesce("x0_tri", middle["x"]), "y0_tri": F.coalesce("y0_tri", middle["y"])})
    return Mesh(mesh.points, tris, corners, e.select(*mesh.edges.columns, "boundary"))


def cell_adjacency(mesh: Mesh) -> DataFrame:
    """(sample, a, b): both directions of every edge."""
    return symmetric(mesh.edges, "from_pt", "to_pt", "sample")


def with_points(mesh: Mesh, points: DataFrame) -> Mesh:
    return replace(mesh, points=points)


def place_ids(points: DataFrame) -> DataFrame:
    """(sample, pt_id, place_id): a number from 0 for each distinct place of a sample, in order of x, then y."""
    rank = F.dense_rank().over(Window.partitionBy("sample").orderBy("x", "y")) - 1
    return points.select("sample", "pt_id", rank.cast("long").alias("place_id"))


def shared_corners(mesh: Mesh) -> DataFrame:
    """(sample, edge_id, pt_id): the points that both triangles of an edge have."""
    dual = mesh.edges.filter("from_tri IS NOT NULL").select("sample", "edge_id", "from_tri", "to_tri")
    corner = lambda end: mesh.tri_vertex.select("sample", F.col("tri_id").alias(end), "pt_id")
    return dual.join(corner("from_tri"), ["sample", "from_tri"]).join(corner("to_tri"), ["sample", "to_tri", "pt_id"]).select("sample", "edge_id", "pt_id")
