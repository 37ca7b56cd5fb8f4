"""Graph primitives over edge tables: components, roots, degrees, adjacency."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meshloom.plans.storage import drop_table, materialize


#: Pieces that the rows of one node are split into for a join, and rows that a task takes together.
SALTS, CHUNK = 64, 500_000


def find_root(up: dict, x):
    """Root of x in a parent map, whose paths it shortens."""
    path = []
    while (p := up.get(x, x)) != x:
        path.append(x)
        x = p
    for y in path:
        up[y] = x
    return x


def in_chunks(df: DataFrame, work, chunk: int) -> DataFrame:
    """mapInArrow of ``work`` (columns of values to columns of values, with the schema of ``df``) over up to about ``chunk`` rows at once, whatever the batches."""
    schema = to_arrow_schema(df.schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from made(held)
                held, n = [], 0
        if held:
            yield from made(held)

    def made(held):
        table = pa.Table.from_batches(held)
        out = work([c.to_pylist() for c in table.columns])
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema).to_batches()

    return df.mapInArrow(run, df.schema)


def _stars(columns: list[list]) -> list[list]:
    """Edges (keys..., u, v) as stars: each node but the least of its connected set, with that least one."""
    *keys, us, vs = columns
    up: dict = {}
    keyed = list(zip(*keys, strict=True)) if keys else [()] * len(us)
    for k, u, v in zip(keyed, us, vs, strict=True):
        a, b = find_root(up, (k, u)), find_root(up, (k, v))
        if a != b:
            up[max(a, b)] = min(a, b)
    rows = [(*x[0], x[1], find_root(up, x)[1]) for x in list(up)]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in columns]


def _chains(columns: list[list]) -> list[list]:
    """Pointers (keys..., node, root) followed as far as the rows at hand go."""
    *keys, nodes, roots = columns
    keyed = list(zip(*keys, strict=True)) if keys else [()] * len(nodes)
    up = {(k, x): (k, r) for k, x, r in zip(keyed, nodes, roots, strict=True)}
    return [*keys, nodes, [find_root(up, (k, x))[1] for k, x in zip(keyed, nodes, strict=True)]]


def symmetric(edges: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Both directions of every edge as (keys..., a, b); repeated pairs and loops are kept out."""
    both = edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))
    back = edges.select(*keys, F.col(b).alias("a"), F.col(a).alias("b"))
    return both.unionByName(back).filter(F.col("a") != F.col("b")).distinct()


def degrees(edges: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Number of edge ends at each node as (keys..., node, degree); a loop counts twice."""
    ends = edges.select(*keys, F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def dealt_join(rows: DataFrame, side: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each value of ``on``. The rows of one value are dealt into ``SALTS`` pieces by ``by``, so that a
    value that a third of all rows have isn't one task's; a value's side row is only repeated for the pieces that it has."""
    dealt = rows.withColumn("__piece", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    asked = dealt.select(*on, "__piece").distinct().join(side, on)
    return dealt.join(asked, [*on, "__piece"], how).drop("__piece")


def _with_least(edges: DataFrame, on: list[str]) -> DataFrame:
    """Edges (on..., v) with ``m``, the least v of their node. The rows of one node are dealt into ``SALTS`` pieces by v, so that a hub isn't one task's."""
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    pieces = dealt.groupBy(*on, "s").agg(F.min("v").alias("m"))
    least = pieces.groupBy(*on).agg(F.min("m").alias("m"), F.collect_set("s").alias("s"))  # SALTS pieces at most
    return dealt.join(least.select(*on, "m", F.explode("s").alias("s")), [*on, "s"]).drop("s")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = (), max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Smallest reachable node id for each node that an edge names: (keys..., node, component). Nodes are told apart within ``keys``.

    One way at every size: each task unites the edges that it holds, ``chunk`` at once, and passes stars on; until no node has two
    parents, or is both a child and a parent, a large-star and a small-star step hooks the neighbours of a node on the smallest of them across tasks, and
    tasks unite again. So few edges, which lie in one partition, are done after the first pass, and a path of n nodes takes O(log^2 n) rounds at most. Every round is
    written to the shared folder, which cuts the lineage, and the table before is removed. Rows of a hub are dealt to many tasks. Edges with a null
    end and loops are ignored; an empty edge table gives an empty result. Nothing is gathered on the driver but one number a round.
    """
    k, on = list(keys), [*keys, "u"]
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    clean = edges.select(*k, F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(in_chunks(clean.select(*k, hi.alias("u"), lo.alias("v")).distinct(), _stars, chunk), "components")
    for _ in range(max_rounds):
        ends = now.select(*k, F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(now.select(*k, "v", F.lit(0), F.lit(1)))
        of_node = ends.groupBy(*k, "node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if not of_node.filter("child > 1 OR (child = 1 AND parent = 1)").agg(F.count("*")).first()[0]:
            break
        both = now.select(*on, "v").union(now.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, on).withColumn("m", F.least("u", "m")).filter("v > u").select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, on)
        stars = small.select(*on, F.col("m").alias("v")).union(small.filter("v <> m").select(*k, F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = materialize(in_chunks(stars, _stars, chunk), "components")
        drop_table(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(*k, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(*k, F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def resolve_roots(parents: DataFrame, keys: list[str], node: str = "node", parent: str = "parent", max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Root of every node of a forest: (keys..., node, root).

    ``parents`` has one row for each node; a null parent marks a root. One way at every size: each task follows the pointers among the rows that it
    holds, ``chunk`` at once; until every pointer is at a root, all jump to where their end points, which doubles their length, and tasks follow again. Rows that
    point to one node are dealt to many tasks. Each round is written to the shared folder.
    """
    keys = list(keys)
    on = [*keys, "root"]
    start = parents.select(*keys, F.col(node).alias("node"), F.coalesce(F.col(parent), F.col(node)).alias("root"))
    now = materialize(in_chunks(start.repartition(*keys, "node"), _chains, chunk), "roots")
    for _ in range(max_rounds):
        above = now.filter("node <> root").select(*keys, F.col("node").alias("root"), F.col("root").alias("above"))
        far = now.select(*on).distinct().join(above, on)
        if far.isEmpty():
            return now
        step = dealt_join(now, above, on, "node", "left").select(*keys, "node", F.coalesce("above", "root").alias("root"))
        after = materialize(in_chunks(step.repartition(*keys, "node"), _chains, chunk), "roots")
        drop_table(now)
        now = after
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds; a cycle?")


def dense_id(order: Column | str, *keys: str) -> Column:
    """Dense 1-based id of the values of ``order`` within ``keys``."""
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(order))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row within ``keys`` in the order of ``order`` (nulls first; rows that tie in all columns of it come in any order).

    Rows are cut into ranges of (keys, order), each is counted, and a row's place is that within its range after those of the ranges before it, so no key needs a task that holds all its rows.
    """
    cut = materialize(df.repartitionByRange(*keys, *order).withColumn("__cut", F.spark_partition_id()), "ranges")
    # a row for each range and key in it
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "__cut").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    side = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cut").alias("__c"), "__before")
    match = F.col("__cut") == F.col("__c")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "__cut").orderBy(*order))
    return cut.withColumn(name, place).join(side, match).select(*df.columns, (F.col(name) + F.col("__before")).alias(name))


def largest_component(edges: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., component, nodes) of the component with most nodes within ``keys``; ties go to the smaller name."""
    sizes = connected_components(edges, a, b, keys).groupBy(*keys, "component").agg(F.count("*").alias("nodes"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("nodes", (-F.col("component")).alias("down"))).alias("m"))
    return best.select(*keys, (-F.col("m.down")).alias("component"), F.col("m.nodes").alias("nodes"))


def _paths(columns: list[list]) -> list[list]:
    """(node, distance, previous) by Dijkstra's rule from edges (node, to, w); a source is a row with itself as the other end."""
    near, found, done, heap = {}, {}, set(), []
    for x, y, w in zip(*columns, strict=True):
        if x == y:
            found[x] = (0.0, None)
            heap.append((0.0, x))
        else:
            near.setdefault(x, []).append((y, w))
    heapq.heapify(heap)
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for y, w in near.get(x, ()):
            if y not in done:
                far, before = found.get(y, (None, None))
                if far is None or d + w < far:
                    found[y] = (d + w, x)
                    heapq.heappush(heap, (d + w, y))
                elif d + w == far and before is not None and x < before:
                    found[y] = (far, x)
    return [list(found), [d for d, _ in found.values()], [p for _, p in found.values()]]


def _paths_of_keys(both: DataFrame, sources: DataFrame, k: list[str]) -> DataFrame:
    """(keys..., node, distance, previous, shorter = false) of keys whose edges fit a task each."""
    kinds = {f.name: f.dataType for f in both.schema}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in k], T.StructField("node", kinds["to"]), T.StructField("distance", T.DoubleType()), T.StructField("previous", kinds["to"])])
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        own = _paths([t[c].to_pylist() for c in ("node", "to", "w")])
        columns = [pa.array([t[c][0].as_py()] * len(own[0]), arrow.field(c).type) for c in k]
        return pa.table([*columns, *[pa.array(c, f.type) for c, f in zip(own, list(arrow)[len(k) :], strict=True)]], schema=arrow)

    rows = both.select(*k, "node", "to", "w").union(sources.select(*k, F.col("node").cast(kinds["node"]).alias("node"), F.col("node").cast(kinds["to"]).alias("to"), F.lit(0.0).alias("w")))
    return rows.groupBy(*k).applyInArrow(run, schema)


def shortest_paths(edges: DataFrame, sources: DataFrame, a: str = "a", b: str = "b", weight: str | None = None, keys: tuple[str, ...] = (), max_rounds: int = 100_000, chunk: int = CHUNK) -> DataFrame:
    """(keys..., node, distance, previous) of every node that can be reached from the ``sources`` (keys..., node): the length of the shortest path from the nearest
    of them, and the node before it there (null at a source; ties go to the smaller one).

    ``edges`` go both ways; ``weight`` names their lengths (1 each if none), and a negative one is an error. Keys of at most ``chunk`` edges (both directions counted) are a task each and take
    one pass. For larger ones rounds pass on only the distances that have got shorter, until none does; each is written to the shared folder. Edges with a null end or length are ignored. The edges of a hub are dealt to many tasks.
    """
    edges, sources = (df.withColumn("__all", F.lit(0)) for df in (edges, sources))
    k = [*keys, "__all"]
    length = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ends = lambda x, y: edges.select(*k, F.col(x).alias("node"), F.col(y).alias("to"), length.alias("w"))
    both = ends(a, b).unionByName(ends(b, a)).filter("node IS NOT NULL AND to IS NOT NULL AND w IS NOT NULL AND node <> to")
    both = materialize(both.groupBy(*k, "node", "to").agg(F.min("w").alias("w")), "path-edges")
    if not both.filter("w < 0 OR isnan(w)").isEmpty():
        raise ValueError("lengths must be numbers of 0 or more")
    kind = both.schema["to"].dataType
    large = materialize(both.groupBy(*k).agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select(*k), "large-keys")
    starts = sources.select(*k, "node").filter("node IS NOT NULL").distinct()
    # a row for each key
    small = materialize(_paths_of_keys(both.join(F.broadcast(large), k, "left_anti"), starts.join(F.broadcast(large), k, "left_anti"), k), "paths")
    if large.isEmpty():
        drop_table(both)
        return small.drop("__all")
    sources, both_ = starts.join(F.broadcast(large), k, "left_semi"), both
    both = both.join(F.broadcast(large), k, "left_semi")
    now = materialize(sources.select(*k, "node").filter("node IS NOT NULL").distinct().select(*k, "node", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("previous"), F.lit(True).alias("shorter")), "paths")
    for _ in range(max_rounds):
        if now.filter("shorter").isEmpty():
            drop_table(both_)
            return small.unionByName(now.drop("shorter")).drop("__all")
        found = dealt_join(both, now.filter("shorter").select(*k, "node", "distance"), [*k, "node"], "to")
        found = found.select(*k, F.col("to").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.col("node").alias("previous"), F.lit(True).alias("shorter"))
        every = now.withColumn("shorter", F.lit(False)).unionByName(found)
        # of equal lengths the known one stays, so that a round without gain is the last
        best = every.groupBy(*k, "node").agg(F.min(F.struct("distance", "shorter", "previous")).alias("m")).select(*k, "node", "m.distance", "m.previous", "m.shorter")
        after = materialize(best, "paths")
        drop_table(now)
        now = after
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def adjacency(nodes: DataFrame, edges: DataFrame, a: str, b: str, *keys: str, node: str = "node") -> DataFrame:
    """(keys..., a, b) in both directions for every node; nodes without neighbours have one row, with a null b."""
    every = nodes.select(*keys, F.col(node).alias("a")).distinct()
    return every.join(symmetric(edges, a, b, *keys), [*keys, "a"], "left")


def colour(edges: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, node, colour): nodes in ascending order take the least colour that no neighbour has. Sequential: a task for each value of ``key``."""
    schema = T.StructType([T.StructField(key, edges.schema[key].dataType), T.StructField("node", edges.schema[a].dataType), T.StructField("colour", T.LongType())])

    def kernel(df: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for x, y in zip(df[a], df[b], strict=True):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        out: dict = {}
        for x in sorted(near):
            taken = {out[y] for y in near[x] if y in out and y != x}
            out[x] = next(c for c in range(len(taken) + 1) if c not in taken)
        return pd.DataFrame({key: [df[key].iloc[0]] * len(out), "node": list(out), "colour": list(out.values())}, columns=schema.names)

    return edges.select(key, a, b).groupBy(key).applyInPandas(lambda df: kernel(df), schema)
