"""The tiling pipeline over all samples at once: mesh, field, Morse tiles, two rounds of merging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators import embed, merge, morse, tiles
from meshloom.operators.field import compute_gradients, scalar
from meshloom.operators.graph import symmetric
from meshloom.operators.mesh import Mesh, add_exterior, build_mesh, cell_adjacency, prune, with_points
from meshloom.plans.ship import ship
from meshloom.plans.storage import materialize, materialize_all, side_by_side


@dataclass(frozen=True)
class Options:
    """Parameters of ``get_tiles``; the defaults are the published ones."""

    npcs: int = 25
    smooth_emb: tuple[int, ...] = (0, 1)
    prune_thresh_quantile: float = 0.99
    prune_min_cells: int = 1
    prune_thresh: float | None = None
    smooth_distance: str = "projected"
    smooth_similarity: str = "projected"
    smooth_iter: int = 1
    on_edges: bool = True
    edge_from_tri: bool = False
    edge_from_pt: bool = False
    f_norm: bool = False
    max_npts: float = 50
    min_npts: float = 5
    alpha: float = 1.0
    meta: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Scalars:
    points: DataFrame
    triangles: DataFrame
    edges: DataFrame


def prepare_mesh(cells: DataFrame, options: Options) -> Mesh:
    """The pruned mesh with its outer triangles."""
    ship(cells.sparkSession)
    mesh = build_mesh(cells, *dict.fromkeys(["emb", *options.meta])).kept()
    return add_exterior(prune(mesh, options.prune_thresh_quantile, options.prune_min_cells, options.prune_thresh)).kept()


def smoothed(mesh: Mesh, dims: int, rounds: tuple[int, ...]) -> tuple[Mesh, int]:
    """The mesh with embeddings smoothed over neighbours, and their new width."""
    if tuple(rounds) == (0,):
        return mesh, dims
    cells = mesh.points.select("sample", F.col("pt_id").alias("cell_id"), "emb")
    emb = embed.smooth_embedding(cells, cell_adjacency(mesh), dims, rounds).withColumnRenamed("cell_id", "pt_id")
    points = mesh.points.drop("emb").join(emb, ["sample", "pt_id"])
    return with_points(mesh, materialize(points, "points")), dims * len(rounds)


def set_f(mesh: Mesh, gradients: dict[str, DataFrame], dims: int, norm: bool = False) -> Scalars:
    """f on points and triangles, ``f_prim`` and ``f_dual`` on edges."""
    e = mesh.edges.join(scalar(gradients["primal"], dims, norm).withColumnRenamed("f", "f_prim"), ["sample", "edge_id"])
    e = e.join(scalar(gradients["dual"], dims, norm).withColumnRenamed("f", "f_dual"), ["sample", "edge_id"])
    return Scalars(scalar(gradients["points"], dims, norm), scalar(gradients["triangles"], dims, norm), e)


def kept_scalars(f: Scalars) -> Scalars:
    """The same scalars, written."""
    return Scalars(*materialize_all({"f-points": f.points, "f-triangles": f.triangles, "f-edges": f.edges}))


def morse_tiles(mesh: Mesh, f: Scalars) -> tuple[DataFrame, DataFrame]:
    """(tiles of points, separatrices)."""
    forests = side_by_side(lambda: morse.primal_forest(f.points, f.edges), lambda: morse.dual_forest(f.triangles, f.edges))
    sep = materialize(morse.separatrices(*forests, f.edges), "separatrices")
    return materialize(morse.assign_tiles(mesh.points, mesh.edges, sep), "tiles"), sep


def grow_and_fill(table: DataFrame, edges: DataFrame, of_points: DataFrame, dims: int, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles of points, tiles, tile edges) after merging similar tiles up to ``max_npts``, and then small ones into their neighbours."""
    for mode in (merge.GROW, merge.FILL):
        params = materialize(merge.mixtures(merge.border_distances(edges, table, dims), mode, o.alpha), "mixtures")
        scored = merge.scores(edges, table, params, dims, mode, o.max_npts, o.min_npts)
        limits = {"max_npts": o.max_npts} if mode == merge.GROW else {"min_npts": o.min_npts}
        mapping, table, edges = merge.merge_tiles(table, scored, params, mode, **limits)
        of_points = materialize(merge.relabel(of_points, mapping), "tiles")
    return of_points, table, edges


def get_tiles(cells: DataFrame, dims: int, counts: DataFrame | None = None, options: Options = Options()) -> dict[str, DataFrame]:
    """Tiles of the cells of every sample.

    ``cells``: (sample, cell_id, x, y[, emb]) and further columns; with ``counts`` (sample, cell_id, gene, count) and no ``emb``, the embedding is their PCA by sample.
    Returns points (with ``tile_id``), tiles, tile_edges, separatrices, tile_counts (with counts), cell_adjacency and tile_adjacency. Ids count within a
    sample; ``consolidate`` makes them unique across samples. Cells that pruning removed have no tile; ``add_isolated`` gives them one each.
    """
    if "emb" not in cells.columns:
        if counts is None:
            raise ValueError("cells need emb, or counts")
        emb, _ = embed.pca(counts, options.npcs)
        width = F.size("emb")
        padded = F.transform(F.sequence(F.lit(0), F.lit(options.npcs - 1)), lambda i: F.when(i < width, F.get("emb", i)).otherwise(F.lit(0.0)))
        cells, dims = cells.join(materialize(emb.withColumn("emb", padded), "pca"), ["sample", "cell_id"]), options.npcs
    mesh, dims = smoothed(prepare_mesh(cells, options), dims, options.smooth_emb)
    g = compute_gradients(mesh, dims, options.smooth_distance, options.smooth_similarity, options.smooth_iter, options.on_edges, options.edge_from_tri, options.edge_from_pt)
    f = set_f(mesh, g, dims, options.f_norm)
    f = kept_scalars(f)
    first, sep = morse_tiles(mesh, f)
    tile_edges = materialize(tiles.tile_edges_of(mesh.edges, first), "tile-ends")
    table = materialize(tiles.tile_table(mesh.points, first, tile_edges, dims), "tile-table")
    of_points, table, edges = grow_and_fill(table, materialize(tiles.tile_adjacency(tile_edges, table), "tile-adjacency"), first, dims, options)
    segments = tiles.outline_segments(tiles.tile_edges_of(mesh.edges, of_points))
    place = tiles.measures(segments).select("sample", "tile_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    out = {
        "points": mesh.points.join(f.points, ["sample", "pt_id"]).join(of_points, ["sample", "pt_id"]),
        "tiles": table.join(place, ["sample", "tile_id"], "left").select("sample", "tile_id", "x", "y", "npts", "area", "perimeter", "emb"),
        "tile_edges": edges, "separatrices": sep, "segments": segments,
        "cell_adjacency": cell_adjacency(mesh), "tile_adjacency": symmetric(edges, "from_tile", "to_tile", "sample"),
    }
    if counts is not None:
        out["tile_counts"] = tiles.tile_counts(counts, of_points)
    return out


def consolidate(table: DataFrame, *ids: str) -> DataFrame:
    """``table`` with ids made unique across samples: "<sample>_<id>"."""
    return table.withColumns({c: F.when(F.col(c).isNotNull(), F.concat_ws("_", F.col("sample").cast("string"), F.col(c).cast("string"))) for c in ids})


def check_unique(table: DataFrame, key: str) -> DataFrame:
    """``table`` itself; an id that occurs twice is an error."""
    if table.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique")
    return table


def bind(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by name; columns that some lack are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def add_isolated(cells: DataFrame, points: DataFrame, table: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(points, tiles) with a tile for each cell that has none: one point, no area, perimeter or border, its own embedding repeated to ``width``."""
    alone = cells.join(points.select("sample", F.col("pt_id").alias("cell_id")), ["sample", "cell_id"], "left_anti")
    last = table.groupBy("sample").agg(F.max("tile_id").alias("last"))
    nth = F.row_number().over(Window.partitionBy("sample").orderBy("cell_id"))
    alone = alone.join(F.broadcast(last), "sample", "left").withColumn("tile_id", F.coalesce("last", F.lit(0)) + nth)
    emb = F.slice(F.flatten(F.array_repeat("emb", width)), 1, width)
    rows = alone.select("sample", "tile_id", "x", "y", F.lit(1).cast("long").alias("npts"), F.lit(None).cast("double").alias("area"), F.lit(None).cast("double").alias("perimeter"), emb.alias("emb"))
    pts = alone.select("sample", F.col("cell_id").alias("pt_id"), "x", "y", "tile_id")
    return points.select("sample", "pt_id", "x", "y", "tile_id").unionByName(pts), table.select(*rows.columns).unionByName(rows)


def write_back(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Cells with the ``tile_id`` of their point; null for those without a tile."""
    return cells.join(points.select("sample", F.col("pt_id").alias("cell_id"), "tile_id"), ["sample", "cell_id"], "left")


def bind_objects(objects: dict[str, dict[str, DataFrame]], ids: tuple[str, ...] = ("tile_id", "from_tile", "to_tile", "a", "b")) -> dict[str, DataFrame]:
    """Tables of several runs of ``get_tiles`` bound by name: a column ``object`` names the run, and tile ids become "<object>_<sample>_<id>", at both ends of edges too.

    Columns that some runs lack are null there; a table that only some runs have holds these runs' rows. Of the columns ``a`` and ``b`` only those of ``tile_adjacency`` are tiles'.
    """
    out: dict[str, list[DataFrame]] = {}
    for name, one in objects.items():
        for table, df in one.items():
            own = [c for c in ids if c in df.columns and (c not in ("a", "b") or table == "tile_adjacency")]
            prefixed = {c: F.when(F.col(c).isNotNull(), F.concat_ws("_", F.lit(name), F.col(c))) for c in own}
            out.setdefault(table, []).append(consolidate(df, *own).withColumns(prefixed).withColumn("object", F.lit(name)))
    return {table: bind(*dfs) for table, dfs in out.items()}


def slice_dims(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Cells with the dimensions ``first`` to ``last`` (from 1, both included) of their embedding."""
    return cells.withColumn("emb", F.slice("emb", first, last - first + 1))
