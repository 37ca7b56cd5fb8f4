"""The queries over the driver's tables, one for each operator, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import analysis, embed, field, graph, integrate, merge, mesh, morse, tiles
from meshloom.operators.graph import connected_components, degrees
from meshloom.operators.neighbours import descend
from meshloom.plans import pipeline
from meshloom.plans.oracle import DIMS, integration_sql, rounded, sql
from meshloom.plans.ship import ship
from meshloom.plans.storage import materialize
from meshloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EDGE_PLACES = ("x0_pt", "x1_pt", "y0_pt", "y1_pt", "x0_tri", "x1_tri", "y0_tri", "y1_tri", "length_pt", "length_tri")


def query(oracle: str | None = None):
    """Register a query under its function's name, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(ship(spark), folder)
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def shown(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """``df`` with columns rounded; minus zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})


def long_field(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """(sample, key, dim, gx, gy): a field in long form."""
    z = df.select("sample", key, F.posexplode(F.arrays_zip("gx", "gy")).alias("dim", "g"))
    return shown(z.select("sample", key, F.col("dim").cast("long").alias("dim"), F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")), "gx", "gy", digits=digits)


def plain_mesh(spark, folder) -> mesh.Mesh:
    return mesh.build_mesh(tables.cells(spark, folder, DIMS), "emb")


def whole_mesh(spark, folder) -> mesh.Mesh:
    return mesh.add_exterior(plain_mesh(spark, folder).kept()).kept()


def field_f(spark, folder) -> tuple[mesh.Mesh, pipeline.Scalars]:
    m = whole_mesh(spark, folder)
    f = pipeline.set_f(m, field.compute_gradients(m, DIMS), DIMS)
    return m, pipeline.kept_scalars(f)


def first_tiles(spark, folder):
    m, f = field_f(spark, folder)
    of_points, _ = pipeline.morse_tiles(m, f)
    e = materialize(tiles.tile_edges_of(m.edges, of_points), "tile-ends")
    return m, of_points, e, materialize(tiles.tile_table(m.points, of_points, e, DIMS), "tile-table")


@query(sql(f"SELECT sample, tri_id, {rounded('x', 'y', 'area', 'height')} FROM tris", "tris"))
def mesh_triangles(spark, folder):
    return shown(plain_mesh(spark, folder).triangles.drop("external"), "x", "y", "area", "height")


@query(sql("SELECT sample, a, b, c FROM faces", "faces"))
def mesh_faces_in_strips(spark, folder):
    """Each sample's triangulation in overlapping strips of 20 points, which gives the triangles of the whole."""
    return mesh.delaunay(mesh.points_of(tables.cells(spark, folder, DIMS)), task=20).select("sample", "a", "b", "c")


@query(sql("SELECT sample, tri_id, pt_id FROM corners", "corners"))
def mesh_corners(spark, folder):
    return plain_mesh(spark, folder).tri_vertex


@query(sql(f"SELECT sample, edge_id, from_pt, to_pt, from_tri, to_tri, {rounded(*EDGE_PLACES)} FROM edges", "edges"))
def mesh_edges(spark, folder):
    return shown(plain_mesh(spark, folder).edges, *EDGE_PLACES)


@query(sql(f"SELECT sample, {rounded('thresh')} FROM cut", "cut"))
def mesh_thresholds(spark, folder):
    return shown(mesh.thresholds(plain_mesh(spark, folder).edges, 0.9), "thresh")


@query(sql("SELECT sample, tri_id FROM kept_tris", "kept_tris"))
def mesh_kept_triangles(spark, folder):
    return mesh.triangles_to_keep(plain_mesh(spark, folder).kept(), 0.9, 6)


@query(sql("""SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY edge_id) AS edge_id, from_pt, to_pt, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN f END AS from_tri, coalesce(t, f) AS to_tri
  FROM (SELECT e.*, k.n AS f, l.n AS t FROM edges e LEFT JOIN numbered k ON k.sample = e.sample AND k.tri_id = e.from_tri LEFT JOIN numbered l ON l.sample = e.sample AND l.tri_id = e.to_tri) WHERE f IS NOT NULL OR t IS NOT NULL""", "kept_tris", "edges").replace("SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY edge_id)", ", numbered AS (SELECT sample, tri_id, row_number() OVER (PARTITION BY sample ORDER BY tri_id) AS n FROM kept_tris) SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY edge_id)"))  # fmt: skip
def mesh_pruned_edges(spark, folder):
    return mesh.prune(plain_mesh(spark, folder).kept(), 0.9, 6).edges.select("sample", "edge_id", "from_pt", "to_pt", "from_tri", "to_tri")


@query(sql(f"SELECT sample, tri_id, {rounded('x', 'y', 'area', 'height')}, external FROM xtris", "xtris"))
def mesh_outer_triangles(spark, folder):
    return shown(mesh.add_exterior(plain_mesh(spark, folder).kept()).triangles, "x", "y", "area", "height")


@query(sql(f"SELECT sample, edge_id, from_tri, to_tri, {rounded('x0_tri', 'y0_tri')}, boundary FROM xedges", "xedges"))
def mesh_outer_edges(spark, folder):
    return shown(mesh.add_exterior(plain_mesh(spark, folder).kept()).edges.select("sample", "edge_id", "from_tri", "to_tri", "x0_tri", "y0_tri", "boundary"), "x0_tri", "y0_tri")


@query(sql("SELECT sample, a, b FROM linked_both", "linked_both"))
def adjacency_of_cells(spark, folder):
    return mesh.cell_adjacency(plain_mesh(spark, folder))


@query(sql("SELECT sample, a AS node, count(*) AS degree FROM linked_both GROUP BY ALL", "linked_both"))
def node_degrees(spark, folder):
    return degrees(plain_mesh(spark, folder).edges, "from_pt", "to_pt", "sample")


@query(sql("SELECT sample, tri_id AS node, component FROM parts p WHERE EXISTS (SELECT 1 FROM near_tris n WHERE n.sample = p.sample AND (n.a = p.tri_id OR n.b = p.tri_id))", "parts"))
def graph_components(spark, folder):
    m = plain_mesh(spark, folder).kept()
    short = m.edges.join(mesh.thresholds(m.edges, 0.9), "sample").filter("length_pt <= thresh")
    good = mesh.incident_triangles(short).groupBy("sample", "tri_id").count().filter("count = 3").select("sample", "tri_id")
    dual = m.edges.filter("from_tri IS NOT NULL")
    for end in ("from_tri", "to_tri"):
        dual = dual.join(good.withColumnRenamed("tri_id", end), ["sample", end], "left_semi")
    return connected_components(dual, "from_tri", "to_tri", ("sample",))


@query(sql(f"SELECT 0 AS sample, cell_id, gene, {rounded('value')} FROM normed", "normed"))
def counts_normalized(spark, folder):
    return shown(embed.normalize(tables.supplier_counts(spark, folder)), "value")


@query(sql(f"""SELECT 0 AS sample, c.cell_id, m.gene, {rounded('z')} FROM (SELECT c.cell_id, m.gene, greatest(least((coalesce(n.value, 0) - m.mu) / nullif(m.sd, 0), 10), -10) AS z FROM (SELECT DISTINCT cell_id FROM supp) c
  CROSS JOIN (SELECT g.gene, avg(v) AS mu, stddev_samp(v) AS sd FROM (SELECT c.cell_id, g.gene, coalesce(n.value, 0) AS v FROM (SELECT DISTINCT cell_id FROM supp) c CROSS JOIN (SELECT DISTINCT gene FROM supp) g LEFT JOIN normed n ON n.cell_id = c.cell_id AND n.gene = g.gene) g GROUP BY g.gene) m
  LEFT JOIN normed n ON n.cell_id = c.cell_id AND n.gene = m.gene) x""".replace("c.cell_id, m.gene, round", "x.cell_id, x.gene, round"), "normed"))  # fmt: skip
def counts_z_scores(spark, folder):
    return shown(embed.z_scores(embed.normalize(tables.supplier_counts(spark, folder))), "z")


@query("SELECT 0 AS sample, user_id AS cell_id, event_type AS gene, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY ALL")
def counts_of_events(spark, folder):
    return tables.event_counts(spark, folder)


@query()
def counts_pca(spark, folder):
    emb, _ = embed.pca(tables.supplier_counts(spark, folder), 5)
    return emb


@query(sql(f"SELECT l.sample, l.a AS cell_id, f.dim, round(avg(f.v), 6) + 0.0 AS v FROM (SELECT * FROM linked_both UNION ALL SELECT sample, pt_id, pt_id FROM cells) l JOIN feats f ON f.sample = l.sample AND f.pt_id = l.b GROUP BY ALL UNION ALL SELECT sample, pt_id, dim - {DIMS}, round(v, 6) + 0.0 FROM feats".replace("f.dim, round(avg", f"f.dim + {0} AS dim, round(avg"), "linked_both", "feats"))
def embedding_smoothed(spark, folder):
    m = plain_mesh(spark, folder)
    cells = m.points.select("sample", F.col("pt_id").alias("cell_id"), "emb")
    out = embed.smooth_embedding(cells, mesh.cell_adjacency(m), DIMS, (0, 1)).select("sample", "cell_id", F.posexplode("emb").alias("dim", "v"))
    return shown(out.select("sample", "cell_id", (F.col("dim") - DIMS).cast("long").alias("dim"), "v"), "v")


@query(sql(f"SELECT sample, pt_id, dim, {rounded('gx', 'gy')} FROM pfield", "pfield"))
def field_of_points(spark, folder):
    m = plain_mesh(spark, folder).kept()
    return long_field(field.point_field(m.edges, m.points, DIMS), "pt_id")


@query(sql(f"SELECT sample, edge_id, dim, {rounded('gx', 'gy')} FROM efield", "efield"))
def field_of_edges(spark, folder):
    m = plain_mesh(spark, folder).kept()
    return long_field(field.edge_field(m.edges, m.points, DIMS), "edge_id")


def _points_smoothed_sql(d: str, s: str) -> str:
    return sql(f"""SELECT w.sample, w.a AS pt_id, f.dim, round(sum(phi*gx)/sum(phi), 5) + 0.0 AS gx, round(sum(phi*gy)/sum(phi), 5) + 0.0 AS gy FROM (SELECT *, exp(-d*d/(2*sd*sd) - s*s/(2*ss*ss)) AS phi FROM (
      SELECT *, coalesce(nullif(avg(d) OVER w, 0), 1) AS sd, coalesce(nullif(avg(s) OVER w, 0), 1) AS ss FROM (SELECT sample, a, b, {d} AS d, {s} AS s FROM ppairs) WINDOW w AS (PARTITION BY sample, a))) w
      JOIN pfield f ON f.sample = w.sample AND f.pt_id = w.b GROUP BY ALL""", "ppairs")  # fmt: skip


def _points_smoothed(distance, similarity):
    def run(spark, folder):
        m = plain_mesh(spark, folder).kept()
        f = materialize(field.point_field(m.edges, m.points, DIMS), "point-field")
        return long_field(field.smooth_points(f, m.edges, m.points, DIMS, distance, similarity), "pt_id", 5)

    run.__name__ = f"field_of_points_{distance}_{similarity}"
    return run


def _edges_smoothed(distance, similarity):
    def run(spark, folder):
        m = plain_mesh(spark, folder).kept()
        f = materialize(field.edge_field(m.edges, m.points, DIMS), "edge-field")
        return long_field(field.smooth_edges(f, m.edges, DIMS, distance, similarity), "edge_id", 5)

    run.__name__ = f"field_of_edges_{distance}_{similarity}"
    return run


POINT_D = {"projected": "sqrt(greatest(dx*dx*g11+2*dx*dy*g12+dy*dy*g22, 0))", "euclidean": "sqrt(dx*dx+dy*dy)", "constant": "1.0"}
POINT_S = {"projected": "greatest(0, 1 - ip/(sqrt(g11+g22)*sqrt(bb)))", "euclidean": "sqrt(greatest(sqrt(g11+g22)*sqrt(g11+g22)+sqrt(bb)*sqrt(bb)-2*ip, 0))", "constant": "1.0"}
for _d, _s in (("projected", "projected"), ("euclidean", "euclidean"), ("constant", "projected"), ("euclidean", "constant")):
    query(_points_smoothed_sql(POINT_D[_d], POINT_S[_s]))(_points_smoothed(_d, _s))
_INNER = "sqrt(m11*m11+m12*m12+m21*m21+m22*m22+2*abs(m11*m22-m12*m21))"
EDGE_D = {"projected": f"{POINT_D['projected']}/2", "euclidean": "sqrt(dx*dx+dy*dy)/2", "constant": "0.0"}
EDGE_S = {"projected": f"greatest(0, 1 - {_INNER}/sqrt((g11+g22)*bb))", "euclidean": f"sqrt(greatest(g11+g22+bb-2*{_INNER}, 0))", "constant": "0.0"}
for _d, _s in (("projected", "projected"), ("euclidean", "projected"), ("projected", "constant")):
    query(sql(f"""SELECT w.sample, w.i AS edge_id, f.dim, round(sum(phi*gx)/sum(phi), 5) + 0.0 AS gx, round(sum(phi*gy)/sum(phi), 5) + 0.0 AS gy FROM (SELECT *, exp(-d*d/(2*sd*sd) - s*s/(2*ss*ss)) AS phi FROM (
      SELECT *, coalesce(nullif(avg(d) OVER w, 0), 1) AS sd, coalesce(nullif(avg(s) OVER w, 0), 1) AS ss FROM (SELECT sample, i, j, {EDGE_D[_d]} AS d, {EDGE_S[_s]} AS s FROM epairs) WINDOW w AS (PARTITION BY sample, i))) w
      JOIN efield f ON f.sample = w.sample AND f.edge_id = w.j GROUP BY ALL""", "epairs"))(_edges_smoothed(_d, _s))  # fmt: skip
query()(_edges_smoothed("projected", "euclidean"))


@query(sql(f"SELECT sample, tri_id, dim, {rounded('gx', 'gy', digits=5)} FROM tris_g", "tris_g"))
def field_of_triangles(spark, folder):
    m = whole_mesh(spark, folder)
    return long_field(field.compute_gradients(m, DIMS)["triangles"], "tri_id", 5)


@query(sql("SELECT sample, edge_id, dim, round(avg(gx), 5) + 0.0 AS gx, round(avg(gy), 5) + 0.0 AS gy FROM (SELECT e.sample, e.edge_id, unnest([from_pt, to_pt]) AS pt_id FROM edges e) JOIN pfield USING (sample, pt_id) GROUP BY ALL", "pfield"))
def field_primal_from_points(spark, folder):
    m = plain_mesh(spark, folder).kept()
    return long_field(field.compute_gradients(m, DIMS, rounds=0, on_edges=False)["primal"], "edge_id", 5)


@query(sql("SELECT c.sample, c.tri_id, dim, round(avg(gx), 5) + 0.0 AS gx, round(avg(gy), 5) + 0.0 AS gy FROM corners c JOIN pfield p ON p.sample = c.sample AND p.pt_id = c.pt_id GROUP BY ALL", "pfield", "corners"))
def field_triangles_from_points(spark, folder):
    m = plain_mesh(spark, folder).kept()
    return long_field(field.compute_gradients(m, DIMS, rounds=0, on_edges=False)["triangles"], "tri_id", 5)


_GRAM = "SELECT sample, pt_id, sum(gx*gx) AS g11, sum(gx*gy) AS g12, sum(gy*gy) AS g22 FROM pfield GROUP BY ALL"
@query(sql(f"""SELECT sample, pt_id, round(cos(t), 5) + 0.0 AS dx_grad, round(sin(t), 5) + 0.0 AS dy_grad, round(sqrt((g11+g22)/2+h), 5) + 0.0 AS len_grad, round(sqrt(greatest((g11+g22)/2-h, 0)), 5) + 0.0 AS len_ortho
  FROM (SELECT *, atan2(2*g12, g11-g22)/2 AS t, sqrt(((g11-g22)/2)**2+g12**2) AS h FROM ({_GRAM}))""", "pfield"))  # fmt: skip
def field_compressed(spark, folder):
    m = plain_mesh(spark, folder).kept()
    c = field.compress(field.point_field(m.edges, m.points, DIMS), DIMS)
    return shown(c.drop("dx_ortho", "dy_ortho"), "dx_grad", "dy_grad", "len_grad", "len_ortho", digits=5)


@query(sql(f"SELECT sample, pt_id, dim, {rounded('gx', 'gy', digits=5)} FROM pfield", "pfield"))
def field_expanded(spark, folder):
    m = plain_mesh(spark, folder).kept()
    f = materialize(field.point_field(m.edges, m.points, DIMS), "point-field")
    c = field.compress(f, DIMS)
    return long_field(field.expand(c, field.right_vectors(f, c, ["sample", "pt_id"], DIMS), ["sample", "pt_id"], DIMS), "pt_id", 5)


@query(sql(f"SELECT sample, pt_id, {rounded('f', digits=4)} FROM pf", "pf"))
def scalar_of_points(spark, folder):
    return shown(field_f(spark, folder)[1].points, "f", digits=4)


@query(sql(f"SELECT sample, tri_id, {rounded('f', digits=4)} FROM tf", "tf"))
def scalar_of_triangles(spark, folder):
    return shown(field_f(spark, folder)[1].triangles, "f", digits=4)


@query(sql("SELECT sample, pt_id, round(sqrt(sum(gx*gx+gy*gy)), 5) + 0.0 AS f FROM pfield GROUP BY ALL", "pfield"))
def scalar_norm(spark, folder):
    m = plain_mesh(spark, folder).kept()
    return shown(field.scalar(field.point_field(m.edges, m.points, DIMS), DIMS, norm=True), "f", digits=5)


@query(sql("SELECT sample, node, parent, parent_edge, root FROM primal", "primal"))
def forest_primal(spark, folder):
    _, f = field_f(spark, folder)
    return morse.primal_forest(f.points, f.edges).select("sample", "node", "parent", "parent_edge", "root")


@query(sql("SELECT sample, node, parent, parent_edge, root FROM dual", "dual"))
def forest_dual(spark, folder):
    _, f = field_f(spark, folder)
    return morse.dual_forest(f.triangles, f.edges).select("sample", "node", "parent", "parent_edge", "root")


@query(sql("SELECT sample, edge_id FROM prim_saddles", "prim_saddles"))
def forest_saddles(spark, folder):
    _, f = field_f(spark, folder)
    return morse.saddles(morse.primal_forest(f.points, f.edges), f.edges, "from_pt", "to_pt")


@query(sql("SELECT sample, node FROM dual WHERE parent IS NULL", "dual"))
def forest_maxima(spark, folder):
    _, f = field_f(spark, folder)
    return morse.critical_nodes(morse.dual_forest(f.triangles, f.edges))


@query(sql("SELECT sample, edge_id FROM sep", "sep"))
def separatrix_edges(spark, folder):
    return pipeline.morse_tiles(*field_f(spark, folder))[1]


@query(sql("SELECT e.sample, e.edge_id FROM xedges e WHERE (e.sample, e.edge_id) NOT IN (SELECT (sample, edge_id) FROM sep)", "sep"))
def edges_off_separatrices(spark, folder):
    m, f = field_f(spark, folder)
    return morse.other_edges(m.edges, pipeline.morse_tiles(m, f)[1])


@query()
def separatrices_without_loose_ends(spark, folder):
    m, f = field_f(spark, folder)
    outer = m.triangles.filter("external").select("sample", "tri_id")
    return morse.prune_separatrices(m.edges, pipeline.morse_tiles(m, f)[1], outer)


@query(sql("SELECT sample, pt_id, tile_id FROM tiles_pt", "tiles_pt"))
def tiles_of_points(spark, folder):
    return pipeline.morse_tiles(*field_f(spark, folder))[0]


@query(sql(f"SELECT sample, tile_id, npts, {rounded('x', 'y', 'area', 'perimeter', digits=5)} FROM tiles", "tiles"))
def tile_measures(spark, folder):
    return shown(first_tiles(spark, folder)[3].drop("emb"), "x", "y", "area", "perimeter", digits=5)


@query(sql(f"SELECT sample, tile_id, dim, {rounded('v')} FROM tile_emb", "tile_emb"))
def tile_embeddings(spark, folder):
    t = first_tiles(spark, folder)[3].select("sample", "tile_id", F.posexplode("emb").alias("dim", "v"))
    return shown(t.select("sample", "tile_id", F.col("dim").cast("long").alias("dim"), "v"), "v")


@query(sql(f"SELECT b.sample, from_tile, to_tile, {rounded('edge_length', digits=5)}, s.npts + t.npts AS npts FROM borders b JOIN tiles s ON s.sample = b.sample AND s.tile_id = b.from_tile JOIN tiles t ON t.sample = b.sample AND t.tile_id = b.to_tile", "borders"))
def tile_borders(spark, folder):
    m, _, e, t = first_tiles(spark, folder)
    return shown(tiles.tile_adjacency(e, t).select("sample", "from_tile", "to_tile", "edge_length", "npts"), "edge_length", digits=5)


@query(sql("SELECT t.sample, t.tile_id, CAST(c.pt_id % 5 AS BIGINT) AS gene, CAST(sum(c.pt_id % 7) AS DOUBLE) AS count FROM cells c JOIN tiles_pt t USING (sample, pt_id) GROUP BY ALL", "tiles_pt"))
def tile_gene_counts(spark, folder):
    _, of_points, _, _ = first_tiles(spark, folder)
    counts = tables.cells(spark, folder, DIMS).select("sample", "cell_id", (F.col("cell_id") % 5).alias("gene"), (F.col("cell_id") % 7).cast("double").alias("count"))
    return tiles.tile_counts(counts, of_points)


def _scores_sql(mode: int) -> str:
    size = "(1-n0/20.0)*(1-n1/20.0)" if mode == merge.GROW else "CAST(1 AS DOUBLE)"
    to = "n1/(n0+n1)*4*pi()*a1/(p1*p1)" if mode == merge.GROW else "n1/(n0+n1)*4*pi()*a0/(p0*p0)"
    never = "n0+n1 >= 20" if mode == merge.GROW else "n0 >= 3 AND n1 >= 3"
    w = f"{'0.5' if mode == merge.GROW else '1.0'} - 1/(1+exp(-(d-0.3)/0.1))"
    dc = f"0.5*(4*pi()*(a0+a1)/pm**2 - n0/(n0+n1)*4*pi()*a0/(p0*p0) - {to} + 1)"
    return sql(f"""SELECT sample, from_tile, to_tile, round({w}, 4) + 0.0 AS w, round({size}, 4) + 0.0 AS score_size, round(pm, 4) + 0.0 AS perimeter_merge, round(CASE WHEN {never} THEN -1.0 ELSE ({w})*{size}*{dc} END, 4) + 0.0 AS dscore
      FROM (SELECT *, p0+p1-2*edge_length AS pm FROM scored)""", "scored")  # fmt: skip


def _scores(mode):
    def run(spark, folder):
        _, _, e, t = first_tiles(spark, folder)
        params = t.select("sample").distinct().select("sample", F.lit(0.3).alias("d_mu"), F.lit(0.1).alias("d_sig"))
        s = merge.scores(tiles.tile_adjacency(e, t), t, params, DIMS, mode, 20, 3)
        return shown(s.select("sample", "from_tile", "to_tile", "w", "score_size", "perimeter_merge", "dscore"), "w", "score_size", "perimeter_merge", "dscore", digits=4)

    run.__name__ = "tile_scores_grow" if mode == merge.GROW else "tile_scores_fill"
    return run


for _mode in (merge.GROW, merge.FILL):
    query(_scores_sql(_mode))(_scores(_mode))


@query(sql("SELECT sample, round(mean + sd, 6) AS d_mu, round(sd, 6) AS d_sig FROM mixed", "mixed"))
def tile_mixtures(spark, folder):
    _, _, e, t = first_tiles(spark, folder)
    return shown(merge.mixtures(merge.border_distances(tiles.tile_adjacency(e, t), t, DIMS), merge.GROW), "d_mu", "d_sig")


@query()
def tile_merging(spark, folder):
    _, _, e, t = first_tiles(spark, folder)
    adj = materialize(tiles.tile_adjacency(e, t), "tile-adjacency")
    params = materialize(merge.mixtures(merge.border_distances(adj, t, DIMS), merge.GROW), "mixtures")
    return merge.merge_tiles(t, merge.scores(adj, t, params, DIMS, merge.GROW, 20), params, merge.GROW, max_npts=20)[0]


@query()
def tile_outlines(spark, folder):
    _, _, e, _ = first_tiles(spark, folder)
    return tiles.outlines(tiles.outline_segments(e)).select("sample", "tile_id", F.size("rings").cast("long").alias("rings"), F.length("wkb").cast("long").alias("wkb_bytes"))


@query()
def tiling(spark, folder):
    out = pipeline.get_tiles(tables.cells(spark, folder, DIMS), DIMS, options=pipeline.Options(max_npts=20))
    return shown(pipeline.consolidate(out["tiles"], "tile_id").select("sample", "tile_id", "npts", "x", "y", "area", "perimeter"), "x", "y", "area", "perimeter")


@query()
def tiling_with_isolated_cells(spark, folder):
    cells = tables.cells(spark, folder, DIMS)
    out = pipeline.get_tiles(cells, DIMS, options=pipeline.Options(max_npts=20, prune_thresh_quantile=0.8, prune_min_cells=4))
    return pipeline.add_isolated(cells, out["points"], out["tiles"], 2 * DIMS)[1].drop("emb")


@query("SELECT concat(l_suppkey, '_', l_linenumber) AS tile_id, count(*) AS n FROM lineitem GROUP BY ALL")
def consolidated_ids(spark, folder):
    t = tables.read(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("tile_id")).agg(F.count("*").alias("n"))
    return pipeline.check_unique(pipeline.consolidate(t, "tile_id").select("tile_id", "n"), "tile_id")


@query("SELECT p_brand AS \"group\", p_partkey AS cell, 1 AS value FROM part WHERE p_brand IS NOT NULL")
def one_hot_groups(spark, folder):
    return analysis.group_matrix(tables.read(spark, folder, "part"), "p_brand", "p_partkey")


def _grouped_sql(how: str) -> str:
    return sql(f"SELECT sample AS \"group\", dim, round({how}(v), 6) + 0.0 AS v FROM feats GROUP BY ALL UNION ALL SELECT -1, NULL, NULL", "feats")


def _grouped(how):
    def run(spark, folder):
        cells = tables.cells(spark, folder, DIMS)
        levels = cells.select(F.col("sample").alias("group")).distinct().union(spark.range(1).select(F.lit(-1).alias("group")))
        out = analysis.aggregate_embeddings(cells, "sample", DIMS, levels, how).select("group", F.posexplode_outer("emb").alias("dim", "v"))
        return shown(out.select("group", F.col("dim").cast("long").alias("dim"), "v"), "v")

    run.__name__ = f"embeddings_{how}_by_group"
    return run


for _how, _agg in (("mean", "avg"), ("sum", "sum")):
    query(_grouped_sql(_agg))(_grouped(_how))


@query(sql("SELECT CAST(dim AS INTEGER) AS dim, CAST(sample AS VARCHAR) AS grp, round(avg(v), 6) + 0.0 AS v FROM feats GROUP BY dim, sample", "feats"))
def embeddings_transposed(spark, folder):
    """The transpose has a column for each group that there is; it is shown in long form, so that it covers every label of any table."""
    means = analysis.aggregate_embeddings(tables.cells(spark, folder, DIMS), "sample", DIMS)
    wide = analysis.transposed(means, analysis.levels(means, "group"))
    return shown(wide.unpivot("dim", [c for c in wide.columns if c != "dim"], "grp", "v").filter("v IS NOT NULL"), "v")


@query("SELECT s_suppkey AS cell_id, s_nationkey AS tile_id, n_name AS nation, n_regionkey AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def metadata_of_tiles(spark, folder):
    cells = tables.read(spark, folder, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("tile_id"))
    side = tables.read(spark, folder, "nation").filter("n_nationkey < 20").withColumnRenamed("n_nationkey", "tile_id")
    return analysis.add_tile_metadata(cells, side, {"n_name": "nation", "n_regionkey": "region"}).select("cell_id", "tile_id", "nation", "region")


@query("SELECT c_custkey AS cell_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE c_mktsegment END AS segment FROM customer")
def labels_merged(spark, folder):
    c = tables.read(spark, folder, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("segment"))
    return analysis.merge_clusters(c, "segment", ["BUILDING", "MACHINERY"], "heavy")[0]


@query("SELECT c_custkey AS cell_id, CASE WHEN c_mktsegment = 'BUILDING' THEN concat('BUILDING_', c_custkey % 3) ELSE c_mktsegment END AS segment FROM customer")
def labels_of_subclusters(spark, folder):
    c = tables.read(spark, folder, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("segment"))
    sub = c.filter("segment = 'BUILDING'").select("cell_id", (F.col("cell_id") % 3).alias("sub"))
    return analysis.add_subcluster_labels(c, sub, "BUILDING", "segment").select("cell_id", "segment")


_KNN = """SELECT id, rank, other, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM (SELECT a.pt_id AS id, b.pt_id AS other, round(1 - sum(a.v*b.v)/(sqrt(sum(a.v*a.v))*sqrt(sum(b.v*b.v))), 12) AS distance
  FROM feats a JOIN feats b ON a.dim = b.dim AND a.pt_id <> b.pt_id GROUP BY a.pt_id, b.pt_id)) WHERE rank <= 10"""
@query(sql(_KNN, "feats"))
def neighbours(spark, folder):
    cells = tables.cells(spark, folder, DIMS).withColumnRenamed("cell_id", "id")
    return shown(analysis.knn(cells, 10).select("id", F.col("rank").cast("long").alias("rank"), "other", "distance"), "distance")


@query(integration_sql(clusters=5, rounds=2, inner=2))
def batches_integrated(spark, folder):
    """Two corrections of two rounds each, with the samples as batches."""
    out = integrate.integrate(tables.cells(spark, folder, DIMS), ["sample"], DIMS, clusters=5, rounds=2, inner=2, early_stop=False)
    return shown(out.select("cell_id", F.posexplode("emb").alias("dim", "v")).withColumn("dim", F.col("dim").cast("long")), "v")


@query()
def neighbours_by_descent(spark, folder):
    """The same lists without all pairs; the tests hold its recall against ``neighbours``."""
    cells = tables.cells(spark, folder, DIMS).withColumnRenamed("cell_id", "id")
    return shown(descend(cells, 10).select("id", F.col("rank").cast("long").alias("rank"), "other", "distance"), "distance")


def fuzzy_cells(spark, folder):
    return analysis.fuzzy_graph(analysis.knn(tables.cells(spark, folder, DIMS).withColumnRenamed("cell_id", "id"), 10))


_FUZZY = """SELECT id, other, round(coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0), 6) + 0.0 AS weight
  FROM members a FULL JOIN (SELECT other AS id, id AS other, w FROM members) b USING (id, other)"""


@query(sql(_FUZZY, "members"))
def fuzzy_neighbour_graph(spark, folder):
    return shown(fuzzy_cells(spark, folder), "weight")


@query()
def neighbour_communities(spark, folder):
    return analysis.communities(fuzzy_cells(spark, folder))


@query()
def neighbour_layout(spark, folder):
    return analysis.layout(fuzzy_cells(spark, folder))


@query()
def subclusters_of_counts(spark, folder):
    counts = tables.supplier_counts(spark, folder)
    cells = counts.select("cell_id").distinct().withColumn("label", F.when(F.col("cell_id") % 3 == 0, "rest").otherwise("most"))
    return analysis.subcluster_counts(cells, counts, "most", "label", 15, 5, 10).select("cell_id", "label")


@query()
def subclusters(spark, folder):
    cells = tables.cells(spark, folder, DIMS).withColumn("label", F.col("sample").cast("string"))
    return analysis.subcluster(cells, "1", "label", 10).select("cell_id", "label")


@query()
def subclusters_without_batches(spark, folder):
    """All cells as one cluster, split after the samples' effect has been taken out."""
    cells = tables.cells(spark, folder, DIMS).withColumn("label", F.lit("all"))
    return analysis.subcluster(cells, "all", "label", 10, batches=("sample",), dims=DIMS).select("cell_id", "label")


@query()
def subclusters_of_tiles(spark, folder):
    m, of_points, _, t = first_tiles(spark, folder)
    m, of_points = m, pipeline.consolidate(of_points, "tile_id")
    t = pipeline.consolidate(t, "tile_id").withColumn("label", F.when(F.col("npts") > 3, "large").otherwise("small"))
    cells = m.points.join(of_points, ["sample", "pt_id"]).withColumnRenamed("pt_id", "cell_id")
    return analysis.tile_subcluster(t.select("sample", "tile_id", "label"), cells, mesh.cell_adjacency(m), "large", "label", DIMS, k=10)


@query()
def subclusters_of_tiles_from_counts(spark, folder):
    m, of_points, _, t = first_tiles(spark, folder)
    of_points = pipeline.consolidate(of_points, "tile_id")
    t = pipeline.consolidate(t, "tile_id").withColumn("label", F.when(F.col("npts") > 3, "large").otherwise("small"))
    cells = m.points.select("sample", "pt_id").join(of_points, ["sample", "pt_id"]).withColumnRenamed("pt_id", "cell_id")
    counts = tables.embedding_counts(spark, folder)
    return analysis.tile_subcluster_counts(t.select("sample", "tile_id", "label"), cells, counts, mesh.cell_adjacency(m), "large", "label", genes=40, npcs=8, k=10, batches=("sample",))


_LEVELS = """SELECT level, row_number() OVER (ORDER BY base, sub) AS place FROM (
    SELECT DISTINCT c_mktsegment AS base, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey % 3 ELSE -1 END AS sub,
      CASE WHEN c_mktsegment = 'BUILDING' THEN concat('BUILDING_', c_custkey % 3) ELSE c_mktsegment END AS level
    FROM customer WHERE c_mktsegment IS NOT NULL)"""


@query(_LEVELS)
def levels_of_subclusters(spark, folder):
    c = tables.read(spark, folder, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("segment"))
    subs = analysis.levels(c.filter("segment = 'BUILDING'").select((F.col("cell_id") % 3).alias("sub")), "sub")
    order = analysis.subcluster_levels(analysis.levels(c, "segment"), "BUILDING", subs)
    return spark.createDataFrame([(x, i) for i, x in enumerate(order, 1)], "level string, place long")


@query(sql("SELECT sample, pt_id, dense_rank() OVER (PARTITION BY sample ORDER BY x, y) - 1 AS place_id FROM cells", "cells"))
def ids_of_places(spark, folder):
    return mesh.place_ids(mesh.points_of(tables.cells(spark, folder, DIMS)))


@query(sql("SELECT e.sample, e.edge_id, c.pt_id FROM edges e JOIN corners c ON c.sample = e.sample AND c.tri_id = e.from_tri JOIN corners d ON d.sample = e.sample AND d.tri_id = e.to_tri AND d.pt_id = c.pt_id", "edges", "corners"))
def corners_shared(spark, folder):
    return mesh.shared_corners(plain_mesh(spark, folder).kept())


@query(sql("SELECT sample, unnest([tile_from, tile_to]) AS tile_id, edge_id FROM tedges WHERE tile_from <> tile_to", "tedges"))
def tile_border_edges(spark, folder):
    return tiles.border_edges(first_tiles(spark, folder)[2])


@query(sql("SELECT DISTINCT sample, unnest([tile_from, tile_to]) AS tile_id, edge_id FROM tedges WHERE boundary", "tedges"))
def tile_hull_edges(spark, folder):
    return tiles.hull_edges(first_tiles(spark, folder)[2])


@query(sql("SELECT sample, tile_id, bool_and(k = 0) AS closed FROM (SELECT sample, tile_id, x, y, sum(k) AS k FROM (SELECT sample, tile_id, px AS x, py AS y, 1 AS k FROM segments UNION ALL SELECT sample, tile_id, qx, qy, -1 FROM segments) GROUP BY ALL) GROUP BY ALL", "segments"))
def tile_circuits(spark, folder):
    return tiles.circuits(tiles.outline_segments(first_tiles(spark, folder)[2]))


@query(sql(f"SELECT sample, tile_id, {rounded('perimeter', digits=5)} FROM measures", "measures"))
def tile_outline_lengths(spark, folder):
    rings = tiles.outlines(tiles.outline_segments(first_tiles(spark, folder)[2])).select("sample", "tile_id", F.explode("rings").alias("ring"))
    return shown(tiles.path_length(rings).groupBy("sample", "tile_id").agg(F.sum("length").alias("perimeter")), "perimeter", digits=5)


_COLOURS = """SELECT o.sample, o.node, m.colours[o.i] AS colour FROM ordered o
  JOIN (SELECT sample, arg_max(colours, i) AS colours FROM painted GROUP BY sample) m ON m.sample = o.sample"""


@query(sql(_COLOURS, "painted"))
def tile_colours(spark, folder):
    _, _, e, t = first_tiles(spark, folder)
    return graph.colour(tiles.tile_adjacency(e, t), "from_tile", "to_tile", "sample")


@query(sql("SELECT sample, component, nodes FROM (SELECT sample, component, count(*) AS nodes, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, component) AS r FROM parts p WHERE EXISTS (SELECT 1 FROM near_tris n WHERE n.sample = p.sample AND (n.a = p.tri_id OR n.b = p.tri_id)) GROUP BY sample, component) WHERE r = 1", "parts"))
def graph_largest_component(spark, folder):
    c = graph_components(spark, folder)
    return graph.largest_component(c.filter("node <> component"), "node", "component", ("sample",))


@query(sql("""SELECT 0 AS sample, gene, round(v / m, 6) + 0.0 AS dispersion FROM (SELECT g.gene, avg(v) AS m, var_samp(v) AS v FROM (SELECT c.cell_id, g.gene, coalesce(n.value, 0) AS v FROM (SELECT DISTINCT cell_id FROM supp) c
  CROSS JOIN (SELECT DISTINCT gene FROM supp) g LEFT JOIN normed n ON n.cell_id = c.cell_id AND n.gene = g.gene) g GROUP BY g.gene) QUALIFY row_number() OVER (ORDER BY v / m DESC, gene) <= 10""", "normed"))  # fmt: skip
def counts_variable_genes(spark, folder):
    return shown(embed.variable_genes(embed.normalize(tables.supplier_counts(spark, folder)), 10), "dispersion")


@query(sql("""SELECT a.cell_id, round(sum(a.z * a.z), 4) + 0.0 AS own, round(sum(a.z * b.z), 4) + 0.0 AS with_first FROM zs a JOIN zs b ON b.gene = a.gene AND b.cell_id = (SELECT min(cell_id) FROM supp) GROUP BY a.cell_id""", "zs"))
def counts_pca_products(spark, folder):
    """All components keep the inner products of the z-scores: each cell's with itself, and with the first cell."""
    emb = materialize(embed.pca(tables.supplier_counts(spark, folder), 30)[0].select("cell_id", F.posexplode("emb").alias("pc", "v")), "pca")
    first = emb.join(emb.agg(F.min("cell_id").alias("cell_id")), "cell_id").select("pc", F.col("v").alias("f"))
    return shown(emb.join(first, "pc").groupBy("cell_id").agg(F.sum(F.col("v") * F.col("v")).alias("own"), F.sum(F.col("v") * F.col("f")).alias("with_first")), "own", "with_first", digits=4)


@query(sql("SELECT sample, node, CAST(min(d) AS DOUBLE) AS distance FROM hops GROUP BY ALL", "hops"))
def graph_distances(spark, folder):
    m = plain_mesh(spark, folder)
    return graph.shortest_paths(m.edges, m.points.groupBy("sample").agg(F.min("pt_id").alias("node")), "from_pt", "to_pt", keys=("sample",)).drop("previous")


@query(sql("SELECT t.sample, t.tile_id AS a, b.other AS b FROM (SELECT DISTINCT sample, tile_id FROM tiles_pt) t LEFT JOIN (SELECT sample, from_tile AS tile_id, to_tile AS other FROM borders UNION SELECT sample, to_tile, from_tile FROM borders) b ON b.sample = t.sample AND b.tile_id = t.tile_id", "borders"))
def tile_graph(spark, folder):
    _, _, e, t = first_tiles(spark, folder)
    return graph.adjacency(t, e, "tile_from", "tile_to", "sample", node="tile_id")


@query(sql("SELECT c.sample, c.pt_id AS cell_id, t.tile_id FROM cells c LEFT JOIN tiles_pt t ON t.sample = c.sample AND t.pt_id = c.pt_id AND t.pt_id % 5 <> 0", "tiles_pt"))
def tiles_of_cells(spark, folder):
    _, of_points, _, _ = first_tiles(spark, folder)
    return pipeline.write_back(tables.cells(spark, folder, DIMS).select("sample", "cell_id"), of_points.filter("pt_id % 5 <> 0"))


@query()
def tile_merging_by_given_scores(spark, folder):
    _, _, e, t = first_tiles(spark, folder)
    adj = tiles.tile_adjacency(e, t).withColumn("dscore", 1 - F.col("npts") / 8)
    return merge.merge_tiles(t, merge.scores(adj, t, None, DIMS, merge.STATIC), None, merge.STATIC)[0]


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def tables_bound(spark, folder):
    n = tables.read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = tables.read(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return pipeline.bind(n, r)


@query("""SELECT vec_id AS cell_id, """ + ", ".join(f"CAST(CASE WHEN max(e{i}) OVER () > min(e{i}) OVER () THEN round(255*(e{i}-min(e{i}) OVER ())/(max(e{i}) OVER ()-min(e{i}) OVER ())) ELSE 0 END AS INTEGER) AS {c}" for i, c in enumerate("rgb")) + " FROM (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 3}] AS DOUBLE) AS e{i}" for i in range(3)) + " FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL)")
def colours_of_cells(spark, folder):
    return analysis.scaled_colours(tables.cells(spark, folder, DIMS)).select("cell_id", "r", "g", "b")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of all samples of the embeddings table."""
    return QUERIES["tiling"](spark, folder)
