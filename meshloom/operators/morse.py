"""Discrete-Morse operators: forests of a scalar field, saddles, separatrices, tiles.

A forest that grows along edges in descending order of f never relabels a node, so each node's parent is the other end of its best
edge, whatever the order of the rest: forests are a best edge for each node and pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.graph import CHUNK, connected_components, dealt_join, in_chunks, resolve_roots
from meshloom.plans.storage import drop_table, materialize


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, node, parent, parent_edge, root) of every node with an edge; roots have neither parent nor parent edge.

    ``nodes``: (sample, node, f); ``edges``: (sample, edge_id, a, b, f). Edges count in descending f, ties by id. Where a node and its parent
    choose the same edge, the root is ``a`` if its f is greater, else ``b``.
    """
    end = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"), F.lit(x == "a").alias("first"))
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("sample", "edge_id", "f", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("sample", "edge_id", "f", "e.*")
    best = ends.groupBy("sample", "node").agg(F.min(F.struct((-F.col("f")).alias("down"), F.col("edge_id"), F.col("other"), F.col("first"))).alias("best"))
    best = materialize(best.select("sample", "node", "best.edge_id", "best.other", "best.first"), "best-edges")
    theirs = best.select("sample", F.col("node").alias("other"), F.col("edge_id").alias("their_edge"))
    nf = nodes.select("sample", "node", "f")
    df = best.join(theirs, ["sample", "other"]).join(nf, ["sample", "node"]).join(nf.withColumnsRenamed({"node": "other", "f": "their_f"}), ["sample", "other"])
    mutual = F.col("edge_id") == F.col("their_edge")
    is_root = mutual & F.when(F.col("first"), F.col("f") > F.col("their_f")).otherwise(~(F.col("their_f") > F.col("f")))
    links = materialize(df.select("sample", "node", F.when(~is_root, F.col("other")).alias("parent"), F.when(~is_root, F.col("edge_id")).alias("parent_edge")), "forest")
    return links.join(resolve_roots(links, ["sample"]), ["sample", "node"])


def primal_forest(points_f: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum forest on points: (sample, pt_id, f) and edges with ``f_prim``."""
    nodes = points_f.select("sample", F.col("pt_id").alias("node"), (-F.col("f")).alias("f"))
    return forest(nodes, edges.select("sample", "edge_id", F.col("from_pt").alias("a"), F.col("to_pt").alias("b"), (-F.col("f_prim")).alias("f")))


def dual_forest(tris_f: DataFrame, edges: DataFrame) -> DataFrame:
    """Maximum forest on triangles: (sample, tri_id, f) and edges with ``f_dual``."""
    nodes = tris_f.select("sample", F.col("tri_id").alias("node"), "f")
    return forest(nodes, edges.select("sample", "edge_id", F.col("from_tri").alias("a"), F.col("to_tri").alias("b"), F.col("f_dual").alias("f")))


def saddles(tree: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(sample, edge_id) of edges whose ends belong to different trees."""
    root = tree.select("sample", "node", "root")
    e = edges.select("sample", "edge_id", a, b)
    e = e.join(root.withColumnsRenamed({"node": a, "root": "ra"}), ["sample", a]).join(root.withColumnsRenamed({"node": b, "root": "rb"}), ["sample", b])
    return e.filter("ra <> rb").select("sample", "edge_id")


def critical_nodes(tree: DataFrame) -> DataFrame:
    """Roots: the minima of a primal forest, the maxima of a dual one."""
    return tree.filter("parent IS NULL").select("sample", "node")


def _marks(columns: list[list]) -> list[list]:
    """Rows (sample, node, up, marked): marks are passed up as far as the rows at hand go."""
    samples, nodes, ups, marked = columns
    at, marked = {k: i for i, k in enumerate(zip(samples, nodes, strict=True))}, list(marked)
    for i in [i for i, m in enumerate(marked) if m]:
        while ups[i] is not None and (j := at.get((samples[i], ups[i]))) is not None and not marked[j]:
            marked[j] = True
            i = j
    return [samples, nodes, ups, marked]


def trace_up(tree: DataFrame, starts: DataFrame, max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(sample, node) of all starts and their ancestors.

    One way at every size: each task passes marks up among the rows that it holds; until every parent of a marked node is marked, the marked
    set is widened by its jumps, whose length doubles each round.
    """
    links = tree.select("sample", "node", F.col("parent").alias("up"))
    rows = links.join(starts.select("sample", "node", F.lit(True).alias("marked")).distinct(), ["sample", "node"], "full").select("sample", "node", "up", F.coalesce("marked", F.lit(False)).alias("marked"))
    rows = materialize(in_chunks(rows.repartition("sample", "node"), _marks, chunk), "marked")
    marked, jump, written = rows.filter("marked").select("sample", "node"), rows.filter("up IS NOT NULL").select("sample", "node", "up"), [rows]
    for _ in range(max_rounds):
        above = rows.filter("up IS NOT NULL").select("sample", "node", "up").join(marked, ["sample", "node"], "left_semi").select("sample", F.col("up").alias("node")).distinct()
        if above.join(marked, ["sample", "node"], "left_anti").isEmpty():
            return marked
        more = materialize(marked.union(marked.join(jump, ["sample", "node"]).select("sample", F.col("up").alias("node"))).distinct(), "marked")
        far = jump.select("sample", F.col("node").alias("up"), F.col("up").alias("above"))
        longer = materialize(dealt_join(jump, far, ["sample", "up"], "node").select("sample", "node", F.col("above").alias("up")), "jumps")
        for t in written[1:]:
            drop_table(t)
        marked, jump, written = more, longer, [rows, more, longer]
    raise RuntimeError("paths did not end; a cycle?")


def saddle_paths(tree: DataFrame, edges: DataFrame, at: DataFrame) -> DataFrame:
    """(sample, edge_id) of the dual edges on the way from both triangles of each saddle up to the maxima."""
    ends = edges.join(at, ["sample", "edge_id"], "left_semi").select("sample", F.explode(F.array("from_tri", "to_tri")).alias("node")).filter("node IS NOT NULL")
    marked = trace_up(tree, ends)
    return tree.join(marked, ["sample", "node"], "left_semi").filter("parent_edge IS NOT NULL").select("sample", F.col("parent_edge").alias("edge_id")).distinct()


def separatrices(primal: DataFrame, dual: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, edge_id): primal saddles that are dual saddles or on the hull, and their paths."""
    border = saddles(dual, edges, "from_tri", "to_tri").union(edges.filter("boundary").select("sample", "edge_id")).distinct()
    both = materialize(saddles(primal, edges, "from_pt", "to_pt").join(border, ["sample", "edge_id"], "left_semi"), "saddles")
    return both.union(saddle_paths(dual, edges, both)).distinct()


def other_edges(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """(sample, edge_id) of the edges that aren't among ``taken``."""
    return edges.select("sample", "edge_id").join(taken, ["sample", "edge_id"], "left_anti")


def prune_separatrices(edges: DataFrame, sep: DataFrame, outer: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Separatrices without loose ends: edges that end alone in an inner triangle go, until none is left."""
    now = materialize(edges.join(sep, ["sample", "edge_id"], "left_semi").select("sample", "edge_id", "from_tri", "to_tri"), "loose")
    for _ in range(max_rounds):
        ends = now.select("sample", "edge_id", F.explode(F.array("from_tri", "to_tri")).alias("tri_id"))
        alone = ends.groupBy("sample", "tri_id").agg(F.count("*").alias("n")).filter("n = 1").join(outer, ["sample", "tri_id"], "left_anti")
        loose = ends.join(alone, ["sample", "tri_id"], "left_semi").select("sample", "edge_id").distinct()
        after = materialize(now.join(loose, ["sample", "edge_id"], "left_anti").select(*now.columns), "loose")
        done = after.count() == now.count()
        drop_table(now)
        now = after
        if done:
            return now.select("sample", "edge_id")
    raise RuntimeError(f"loose ends are left after {max_rounds} rounds")


def assign_tiles(points: DataFrame, edges: DataFrame, sep: DataFrame) -> DataFrame:
    """(sample, pt_id, tile_id): components of the points without the separatrices, numbered by their lowest point."""
    inner = edges.join(sep, ["sample", "edge_id"], "left_anti")
    comp = connected_components(inner, "from_pt", "to_pt", ("sample",)).withColumnRenamed("node", "pt_id")
    labelled = points.select("sample", "pt_id").join(comp, ["sample", "pt_id"], "left").withColumn("component", F.coalesce("component", "pt_id"))
    numbered = labelled.select("sample", "component").distinct().withColumn("tile_id", F.row_number().over(Window.partitionBy("sample").orderBy("component")).cast("long"))
    return labelled.join(numbered, ["sample", "component"]).select("sample", "pt_id", "tile_id")
