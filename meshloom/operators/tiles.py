"""Tables of tiles: places, sizes, areas, borders, embeddings, counts, outlines."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.functions.vectors import mean_arrays


def tile_edges_of(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges with ``tile_from`` and ``tile_to``."""
    end = lambda e: tiles.select("sample", F.col("pt_id").alias(f"{e}_pt"), F.col("tile_id").alias(f"tile_{e}"))
    return edges.join(end("from"), ["sample", "from_pt"]).join(end("to"), ["sample", "to_pt"])


def outline_segments(edges: DataFrame) -> DataFrame:
    """(sample, tile_id, px, py, qx, qy): directed pieces of the tiles' outlines, the tile at the left.

    ``edges`` have tiles at their ends and two triangles (outer ones at the middle of hull edges).
    """
    e = edges
    left = (F.col("x1_pt") - F.col("x0_pt")) * (F.col("y1_tri") - F.col("y0_pt")) - (F.col("y1_pt") - F.col("y0_pt")) * (F.col("x1_tri") - F.col("x0_pt")) > 0
    e = e.withColumns({"left": left, "apart": F.col("tile_from") != F.col("tile_to")})
    a, b, m, t = ("x0_pt", "y0_pt"), ("x1_pt", "y1_pt"), ("x0_tri", "y0_tri"), ("x1_tri", "y1_tri")
    # (tile, p, q) where to_tri is at the left of from -> to; turned round otherwise
    seg = lambda tile, p, q: F.struct(F.col(tile).alias("tile_id"), *[F.when(F.col("left"), F.col(p[i])).otherwise(F.col(q[i])).alias(f"p{c}") for i, c in enumerate("xy")], *[F.when(F.col("left"), F.col(q[i])).otherwise(F.col(p[i])).alias(f"q{c}") for i, c in enumerate("xy")])
    between = F.array(seg("tile_from", m, t), seg("tile_to", t, m))
    halves = F.array(seg("tile_from", a, m), seg("tile_to", m, b))
    none = F.slice(between, 1, 0)
    both = F.concat(F.when(F.col("apart"), between).otherwise(none), F.when(F.col("apart") & F.col("boundary"), halves).otherwise(none), F.when(~F.col("apart") & F.col("boundary"), F.array(seg("tile_from", a, b))).otherwise(none))
    return e.select("sample", F.explode(both).alias("s")).select("sample", "s.*")


def measures(segments: DataFrame) -> DataFrame:
    """(sample, tile_id, area, perimeter, cx, cy) from unordered segments: sums of cross products and lengths; holes count as such."""
    cross = F.col("px") * F.col("qy") - F.col("qx") * F.col("py")
    g = segments.groupBy("sample", "tile_id").agg(
        (F.sum(cross) / 2).alias("area"),
        F.sum(F.sqrt((F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2)).alias("perimeter"),
        F.sum((F.col("px") + F.col("qx")) * cross).alias("mx"),
        F.sum((F.col("py") + F.col("qy")) * cross).alias("my"),
    )
    centre = lambda m: F.when(F.col("area") != 0, F.col(m) / (6 * F.col("area")))
    return g.select("sample", "tile_id", "area", "perimeter", centre("mx").alias("cx"), centre("my").alias("cy"))


def tile_table(points: DataFrame, tiles: DataFrame, edges: DataFrame, dims: int) -> DataFrame:
    """(sample, tile_id, x, y, npts, area, perimeter, emb): means over the tile's points; ``edges`` have tiles at their ends."""
    rows = points.select("sample", "pt_id", "x", "y", "emb").join(tiles, ["sample", "pt_id"])
    means = mean_arrays(rows, ["sample", "tile_id"], ["emb"], dims, more=[F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("npts")])
    return means.join(measures(outline_segments(edges)), ["sample", "tile_id"], "left").select("sample", "tile_id", "x", "y", "npts", "area", "perimeter", "emb")


def tile_adjacency(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """(sample, from_tile, to_tile, edge_length, x0, y0, x1, y1, npts, area): each pair of neighbours once, with the length of their border."""
    pairs = edges.filter("tile_from <> tile_to").select("sample", F.least("tile_from", "tile_to").alias("from_tile"), F.greatest("tile_from", "tile_to").alias("to_tile"), F.sqrt((F.col("x1_tri") - F.col("x0_tri")) ** 2 + (F.col("y1_tri") - F.col("y0_tri")) ** 2).alias("l"))
    e = pairs.groupBy("sample", "from_tile", "to_tile").agg(F.sum("l").alias("edge_length"))
    side = lambda n, k: tiles.select("sample", F.col("tile_id").alias(n), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("npts").alias(f"n{k}"), F.col("area").alias(f"a{k}"))
    e = e.join(side("from_tile", 0), ["sample", "from_tile"]).join(side("to_tile", 1), ["sample", "to_tile"])
    return e.select("sample", "from_tile", "to_tile", "edge_length", "x0", "y0", "x1", "y1", (F.col("n0") + F.col("n1")).alias("npts"), (F.col("a0") + F.col("a1")).alias("area"))


def tile_counts(counts: DataFrame, tiles: DataFrame) -> DataFrame:
    """(sample, tile_id, gene, count): sums over a tile's cells."""
    joined = counts.join(tiles.withColumnRenamed("pt_id", "cell_id"), ["sample", "cell_id"])
    return joined.groupBy("sample", "tile_id", "gene").agg(F.sum("count").alias("count"))


def path_length(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """``rings`` with ``length``: the sum of the distances between consecutive places of an array<struct<x,y>>."""
    steps = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2))
    return rings.withColumn("length", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x))


def border_edges(edges: DataFrame) -> DataFrame:
    """(sample, tile_id, edge_id) of the edges whose dual runs along a tile's border."""
    apart = edges.filter("tile_from <> tile_to")
    return apart.select("sample", F.explode(F.array("tile_from", "tile_to")).alias("tile_id"), "edge_id")


def hull_edges(edges: DataFrame) -> DataFrame:
    """(sample, tile_id, edge_id) of the hull edges with an end in a tile."""
    return edges.filter("boundary").select("sample", F.explode(F.array_distinct(F.array("tile_from", "tile_to"))).alias("tile_id"), "edge_id")


def circuits(segments: DataFrame) -> DataFrame:
    """(sample, tile_id, closed): whether as many segments end at each place of a tile's outline as begin there, so that it can be walked in circuits."""
    begins = segments.select("sample", "tile_id", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(1).alias("k"))
    ends = segments.select("sample", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"), F.lit(-1).alias("k"))
    places = begins.unionByName(ends).groupBy("sample", "tile_id", "x", "y").agg(F.sum("k").alias("k"))
    return places.groupBy("sample", "tile_id").agg(F.every(F.col("k") == 0).alias("closed"))


def walk_rings(segments: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed simple rings from directed segments: a walk takes the first unused segment of a place, and a loop is cut off as soon as it comes back to a place it has passed."""
    leaving: dict[tuple, list[tuple]] = {}
    for px, py, qx, qy in sorted(segments):
        if (px, py) != (qx, qy):
            leaving.setdefault((px, py), []).append((qx, qy))
    rings = []
    for start in sorted(leaving):
        while leaving[start]:
            path, passed, at = [start], {start: 0}, leaving[start].pop(0)
            while True:
                if at in passed:
                    k = passed[at]
                    rings.append([*path[k:], at])
                    for p in path[k + 1 :]:
                        del passed[p]
                    del path[k + 1 :]
                else:
                    passed[at] = len(path)
                    path.append(at)
                if not leaving.get(at):
                    break
                at = leaving[at].pop(0)
            if len(path) > 1:  # segments that don't close are closed
                rings.append([*path, start])
    return rings


def ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2


def within(place: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    """Whether a ray from the place crosses the ring an odd number of times."""
    x, y = place
    odd = False
    for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
        if (py > y) != (qy > y) and x < px + (y - py) / (qy - py) * (qx - px):
            odd = not odd
    return odd


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """A multipolygon as well-known binary: each outer ring a polygon, each hole with the smallest outer ring around it; rings without area, and holes outside all, are left out."""
    outer = sorted((r for r in rings if ring_area(r) > 0), key=ring_area)
    polygons = [[r] for r in outer]
    for hole in (r for r in rings if ring_area(r) < 0):
        # the middle of a side: no side of a hole is one of an outer ring, but corners may be shared
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        if (home := next((p for p in polygons if within(middle, p[0])), None)) is not None:
            home.append(hole)
    out = struct.pack("<BII", 1, 6, len(polygons))
    for p in polygons:
        out += struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *q) for q in r) for r in p)
    return out


def outlines(segments: DataFrame) -> DataFrame:
    """(sample, tile_id, rings array<array<struct<x,y>>>, wkb): every ring of each tile, holes included. A tile's outline is walked in one task."""
    kinds = {f.name: f.dataType for f in segments.schema}
    place = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType([T.StructField("sample", kinds["sample"]), T.StructField("tile_id", kinds["tile_id"]), T.StructField("rings", T.ArrayType(T.ArrayType(place))), T.StructField("wkb", T.BinaryType())])

    def kernel(df: pd.DataFrame) -> pd.DataFrame:
        rings = walk_rings(list(df[["px", "py", "qx", "qy"]].itertuples(index=False, name=None)))
        shown = [[{"x": x, "y": y} for x, y in r] for r in rings]
        return pd.DataFrame({"sample": [df["sample"].iloc[0]], "tile_id": [df["tile_id"].iloc[0]], "rings": [shown], "wkb": [polygon_wkb(rings)]})

    return segments.groupBy("sample", "tile_id").applyInPandas(kernel, schema)
