"""Gradient fields of the embedding on points, edges and triangles, and their smoothing.

A field has two array columns, ``gx`` and ``gy``: the derivatives of each feature along x and y. What a singular value
decomposition of such a 2 x D matrix would give comes from its Gram matrix in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.vectors import dot, mean_arrays, scaled_difference

DISTANCES, SIMILARITIES = ("euclidean", "projected", "constant", "none"), ("euclidean", "projected", "constant", "none")


def _check(distance: str, similarity: str) -> None:
    if distance not in DISTANCES or similarity not in SIMILARITIES:
        raise ValueError(f"distance is one of {DISTANCES}, similarity one of {SIMILARITIES}")


def edge_field(edges: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """(sample, edge_id, gx, gy): unit vector from end to end, times the difference of the embeddings."""
    p = points.select("sample", "pt_id", "emb")
    e = edges.select("sample", "edge_id", "from_pt", "to_pt", "x0_pt", "x1_pt", "y0_pt", "y1_pt", "length_pt")
    e = e.join(p.withColumnsRenamed({"pt_id": "from_pt", "emb": "emb0"}), ["sample", "from_pt"]).join(p.withColumnsRenamed({"pt_id": "to_pt", "emb": "emb1"}), ["sample", "to_pt"])
    unit = lambda c: (F.col(f"{c}1_pt") - F.col(f"{c}0_pt")) / F.col("length_pt")
    return e.select("sample", "edge_id", *[scaled_difference(unit(c), "emb0", "emb1", dims).alias(f"g{c}") for c in "xy"])


def _both_ways(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Each edge from either end: (sample, a, b, dx, dy, length_pt), b - a in place."""
    d = [F.col(f"{c}1_pt") - F.col(f"{c}0_pt") for c in "xy"]
    out = edges.select("sample", F.col("from_pt").alias("a"), F.col("to_pt").alias("b"), d[0].alias("dx"), d[1].alias("dy"), "length_pt")
    return out.unionByName(out.select("sample", F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), "length_pt"))


def point_field(edges: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """(sample, pt_id, gx, gy): mean over neighbours of unit direction times difference of embeddings. The term of an edge is the same from either end."""
    at_ends = edges.select("sample", "edge_id", F.explode(F.array("from_pt", "to_pt")).alias("pt_id"))
    return mean_arrays(at_ends.join(edge_field(edges, points, dims), ["sample", "edge_id"]), ["sample", "pt_id"], ["gx", "gy"], dims)


def gram(dims: int, gx: str = "gx", gy: str = "gy") -> tuple[Column, Column, Column]:
    return dot(gx, gx, dims), dot(gx, gy, dims), dot(gy, gy, dims)


def _weights(pairs: DataFrame, key: list[str], dims: int) -> DataFrame:
    """Bilateral weighting: pairs with ``d``, ``s`` and the neighbour's field, averaged with exp(-d²/2σ² - s²/2τ²), σ and τ the means (1 if zero)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key)
    mean = lambda c: F.when(F.avg(c).over(w) == 0, F.lit(1.0)).otherwise(F.avg(c).over(w))
    phi = F.exp(-(F.col("d") ** 2) / (2 * mean("d") ** 2) - (F.col("s") ** 2) / (2 * mean("s") ** 2))
    return mean_arrays(pairs.withColumn("phi", phi), key, ["gx", "gy"], dims, F.col("phi"))


def smooth_points(field: DataFrame, edges: DataFrame, points: DataFrame, dims: int, distance: str = "projected", similarity: str = "projected", include_self: bool = True) -> DataFrame:
    """Bilateral filter of a point field over neighbours, and the point itself if asked. 'none' for either leaves the field as it is."""
    _check(distance, similarity)
    if "none" in (distance, similarity):
        return field
    links = _both_ways(edges, points).drop("length_pt")
    if include_self:
        own = field.select("sample", F.col("pt_id").alias("a"), F.col("pt_id").alias("b"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
        links = links.unionByName(own)
    fa = field.select("sample", F.col("pt_id").alias("a"), F.col("gx").alias("ax"), F.col("gy").alias("ay"))
    fb = field.select("sample", F.col("pt_id").alias("b"), "gx", "gy")
    p = links.join(fa, ["sample", "a"]).join(fb, ["sample", "b"])
    dx, dy = F.col("dx"), F.col("dy")
    g11, g12, g22 = gram(dims, "ax", "ay")
    inner = dot("ax", "gx", dims) + dot("ay", "gy", dims)
    na, nb = F.sqrt(g11 + g22), F.sqrt(dot("gx", "gx", dims) + dot("gy", "gy", dims))
    d = {"euclidean": F.sqrt(dx * dx + dy * dy), "projected": F.sqrt(F.greatest(dx * dx * g11 + 2 * dx * dy * g12 + dy * dy * g22, F.lit(0.0))), "constant": F.lit(1.0)}[distance]
    s = {"euclidean": F.sqrt(F.greatest(na * na + nb * nb - 2 * inner, F.lit(0.0))), "projected": F.greatest(F.lit(0.0), 1 - inner / (na * nb)), "constant": F.lit(1.0)}[similarity]
    return _weights(p.withColumns({"d": d, "s": s}), ["sample", "a"], dims).withColumnRenamed("a", "pt_id")


def smooth_edges(field: DataFrame, edges: DataFrame, dims: int, distance: str = "projected", similarity: str = "projected") -> DataFrame:
    """Bilateral filter of an edge field over the edges at either end; the edge itself counts at both.

    Distances are between midpoints. Similarity is after the best rotation or reflection in the plane: with M = B Aᵀ, the inner product is
    sqrt(‖M‖² + 2 |det M|).
    """
    _check(distance, similarity)
    if "none" in (distance, similarity):
        return field
    end = lambda at, other, x, y, ox, oy: F.struct(F.col(at).alias("at"), F.col(ox).alias("px"), F.col(oy).alias("py"))
    ends = edges.select("sample", "edge_id", F.explode(F.array(end("from_pt", "to_pt", "x0_pt", "y0_pt", "x1_pt", "y1_pt"), end("to_pt", "from_pt", "x1_pt", "y1_pt", "x0_pt", "y0_pt"))).alias("e")).select("sample", "edge_id", "e.*")
    left = ends.withColumnsRenamed({"px": "ix", "py": "iy"})
    right = ends.withColumnRenamed("edge_id", "j")
    p = left.join(right, ["sample", "at"])
    p = p.join(field.withColumnsRenamed({"gx": "ax", "gy": "ay"}), ["sample", "edge_id"]).join(field.withColumnRenamed("edge_id", "j"), ["sample", "j"])
    dx, dy = F.col("px") - F.col("ix"), F.col("py") - F.col("iy")
    g11, g12, g22 = gram(dims, "ax", "ay")
    m11, m12, m21, m22 = dot("gx", "ax", dims), dot("gx", "ay", dims), dot("gy", "ax", dims), dot("gy", "ay", dims)
    inner = F.sqrt(m11 * m11 + m12 * m12 + m21 * m21 + m22 * m22 + 2 * F.abs(m11 * m22 - m12 * m21))
    aa, bb = g11 + g22, dot("gx", "gx", dims) + dot("gy", "gy", dims)
    d = {"euclidean": F.sqrt(dx * dx + dy * dy) / 2, "projected": F.sqrt(F.greatest(dx * dx * g11 + 2 * dx * dy * g12 + dy * dy * g22, F.lit(0.0))) / 2, "constant": F.lit(0.0)}[distance]
    s = {"euclidean": F.sqrt(F.greatest(aa + bb - 2 * inner, F.lit(0.0))), "projected": F.greatest(F.lit(0.0), 1 - inner / F.sqrt(aa * bb)), "constant": F.lit(0.0)}[similarity]
    return _weights(p.withColumns({"d": d, "s": s}), ["sample", "edge_id"], dims)


def to_triangles(point_field_: DataFrame, tri_vertex: DataFrame, dims: int) -> DataFrame:
    """Mean of a triangle's corners (two for an outer one): (sample, tri_id, gx, gy)."""
    return mean_arrays(tri_vertex.join(point_field_, ["sample", "pt_id"]), ["sample", "tri_id"], ["gx", "gy"], dims)


def edges_to(field: DataFrame, edges: DataFrame, ends: tuple[str, str], name: str, dims: int) -> DataFrame:
    """Mean of the edges at each point or triangle: ``ends`` are the edge table's columns, ``name`` the id's."""
    at = edges.select("sample", "edge_id", F.explode(F.array(*ends)).alias(name)).filter(F.col(name).isNotNull())
    return mean_arrays(at.join(field, ["sample", "edge_id"]), ["sample", name], ["gx", "gy"], dims)


def to_edges(field: DataFrame, edges: DataFrame, ends: tuple[str, str], name: str, dims: int) -> DataFrame:
    """Mean of an edge's two ends: (sample, edge_id, gx, gy)."""
    at = edges.select("sample", "edge_id", F.explode(F.array(*ends)).alias(name)).filter(F.col(name).isNotNull())
    return mean_arrays(at.join(field, ["sample", name]), ["sample", "edge_id"], ["gx", "gy"], dims)


POINTS, TRIANGLES = ("from_pt", "to_pt"), ("from_tri", "to_tri")


def compute_gradients(mesh, dims: int, distance: str = "projected", similarity: str = "projected", rounds: int = 1, on_edges: bool = True, edge_from_tri: bool = False, edge_from_pt: bool = False) -> dict[str, DataFrame]:
    """Fields on points, triangles, primal and dual edges.

    From edges: the smoothed edge field, and means of it at points and triangles; ``edge_from_tri`` then takes edges from triangles, ``edge_from_pt``
    primal edges from points. Otherwise from points: triangles, primal edges and dual edges are means of points and triangles.
    """
    from meshloom.plans.storage import materialize

    if on_edges:
        f = edge_field(mesh.edges, mesh.points, dims)
        for _ in range(rounds):
            f = materialize(smooth_edges(materialize(f, "edge-field"), mesh.edges, dims, distance, similarity), "edge-field")
        tris, pts = edges_to(f, mesh.edges, TRIANGLES, "tri_id", dims), edges_to(f, mesh.edges, POINTS, "pt_id", dims)
        dual = to_edges(tris, mesh.edges, TRIANGLES, "tri_id", dims) if edge_from_tri else f
        primal = to_edges(pts, mesh.edges, POINTS, "pt_id", dims) if edge_from_pt else dual
        return {"points": pts, "triangles": tris, "primal": primal, "dual": dual}
    f = point_field(mesh.edges, mesh.points, dims)
    for _ in range(rounds):
        f = materialize(smooth_points(materialize(f, "point-field"), mesh.edges, mesh.points, dims, distance, similarity), "point-field")
    tris = to_triangles(f, mesh.tri_vertex, dims)
    return {"points": f, "triangles": tris, "primal": to_edges(f, mesh.edges, POINTS, "pt_id", dims), "dual": to_edges(tris, mesh.edges, TRIANGLES, "tri_id", dims)}


def compress(field: DataFrame, dims: int) -> DataFrame:
    """The field's directions and lengths: gradient (greatest change) and orthogonal, from the 2 x 2 Gram matrix.

    Directions are unit vectors up to sign; the gradient's is made to point to positive x (or y, if x is zero).
    """
    g11, g12, g22 = gram(dims)
    keys = [c for c in field.columns if c not in ("gx", "gy")]
    df = field.select(*keys, g11.alias("g11"), g12.alias("g12"), g22.alias("g22"))
    gap = F.sqrt(((F.col("g11") - F.col("g22")) / 2) ** 2 + F.col("g12") ** 2)
    df = df.withColumn("l1", (F.col("g11") + F.col("g22")) / 2 + gap).withColumn("l2", F.greatest((F.col("g11") + F.col("g22")) / 2 - gap, F.lit(0.0)))
    angle = F.atan2(2 * F.col("g12"), F.col("g11") - F.col("g22")) / 2
    c, s = F.cos(angle), F.sin(angle)
    return df.select(*keys, c.alias("dx_grad"), s.alias("dy_grad"), (-s).alias("dx_ortho"), c.alias("dy_ortho"), F.sqrt("l1").alias("len_grad"), F.sqrt("l2").alias("len_ortho"))


def expand(compressed: DataFrame, right: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """The field again from directions, lengths and right vectors (v1, v2): the inverse of a decomposition."""
    df = compressed.join(right, keys)
    row = lambda c: F.array(*[F.col(f"d{c}_grad") * F.col("len_grad") * F.col("v1")[i] + F.col(f"d{c}_ortho") * F.col("len_ortho") * F.col("v2")[i] for i in range(dims)]).alias(f"g{c}")
    return df.select(*keys, row("x"), row("y"))


def right_vectors(field: DataFrame, compressed: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """(keys, v1, v2): the feature-space directions that go with the compressed field; zeros for a zero length."""
    df = field.join(compressed, keys)
    v = lambda k: F.array(*[F.when(F.col(f"len_{k}") > 0, (F.col(f"dx_{k}") * F.col("gx")[i] + F.col(f"dy_{k}") * F.col("gy")[i]) / F.col(f"len_{k}")).otherwise(0.0) for i in range(dims)])
    return df.select(*keys, v("grad").alias("v1"), v("ortho").alias("v2"))


def scalar(field: DataFrame, dims: int, norm: bool = False) -> DataFrame:
    """(keys, f): sum of the two lengths, or with ``norm`` the Frobenius norm of each row's field."""
    g11, g12, g22 = gram(dims)
    keys = [c for c in field.columns if c not in ("gx", "gy")]
    df = field.select(*keys, g11.alias("g11"), g12.alias("g12"), g22.alias("g22"))
    trace = F.col("g11") + F.col("g22")
    det = F.greatest(F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12"), F.lit(0.0))
    return df.select(*keys, F.sqrt(trace if norm else trace + 2 * F.sqrt(det)).alias("f"))
