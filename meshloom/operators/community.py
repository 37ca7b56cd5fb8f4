"""Communities of a weighted graph by modularity, with refinement, over an edge table.

A level has three parts. Moves: every node starts where the level before left it, and nodes move to the neighbouring community of the greatest gain until none gains.
Refinement: within each community every node starts alone; nodes that are still alone join the refined part of greatest gain among their neighbours', so each
part is connected by construction. Contraction: parts become nodes, their edges are summed, and the next level starts from the communities of the moves. It
ends at the level whose moves or refinement unite nothing; its communities are single nodes, which are connected.

A level of more than ``CHUNK`` edges is cut into blocks of whole communities that lie near each other in the graph, about ``CHUNK`` edges each. A task moves the nodes of a block among the block's
communities, which no other task changes, so gains are exact; it refines them, and the parts of all blocks are contracted. Edges between blocks count from the next level on, whose blocks are others. So a level is one
pass and not rounds. Only where blocks unite less than a tenth of the nodes, moves go in rounds over all tasks, as follows.

Nodes are dealt to tasks by a hash, as many tasks as the edges need. A task takes its nodes in order and sees the moves that it has made itself. What it sees of other tasks'
nodes is as of the round's start: the weight of each node's edges into each of their communities, summed before it gets there, and of these the ``CHOICES`` of greatest gain; rounds go on until no
node gains, so a choice left out in one round isn't lost. Nodes with neighbours in other tasks move in every other turn by a hash, so that no two swap. A level that fits one
task (``CHUNK`` edges), as every graph does after some levels, is finished there. Joins on nodes deal a hub's rows to many tasks; no community or hub is gathered. Rounds are written to the shared folder, a row a node.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.graph import CHUNK, connected_components, dealt_join
from meshloom.plans.storage import drop_table, materialize

#: Gains below this are none; communities of other tasks that a node chooses among in one round.
LEAST_GAIN, CHOICES = 1e-12, 64
#: Regions that are grown for a block, and steps that they grow by.
REGIONS, STEPS = 8, 8


def _active(node: str, turn: int) -> Column:
    """Half of the nodes, another half in each turn."""
    return F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(2)) == 0


def _walk(home: dict, weight: dict, size: dict, number: dict, far: dict, near: dict, may: dict, resolution: float, total: float, alone: bool, least: dict | None = None) -> tuple[set, Callable]:
    """Move nodes in order, and again those whose neighbours moved, until none gains; ``home``, ``size`` and ``number`` are changed. Gives the nodes that moved and the function that chooses.

    ``near``: edges to nodes at hand; ``far``: weight of edges into groups by others and whether they may be joined; a node with far edges only moves where ``may`` says so. With ``alone`` only nodes
    that are alone in their group move. ``least``: what a node has to gain in a group to join it.
    """
    least = least or {}

    def choice(v):
        """The group where ``v`` gains most over its own, ties to the smaller name; None if it gains nowhere."""
        h, k = home[v], weight[v]
        pull = {g: w for g, (w, _) in far.get(v, {}).items()}
        open_ = {g for g, (_, go) in far.get(v, {}).items() if go}
        for u, w in near.get(v, ()):
            g = home[u]
            pull[g] = pull.get(g, 0.0) + w
            open_.add(g)
        stay = round(pull.get(h, 0.0) - resolution * k * (size[h] - k) / total, 12)
        best, to = LEAST_GAIN * k, None
        for g, w in pull.items():
            if g != h and g in open_:
                gain = round(w - resolution * k * size[g] / total, 12)
                more = gain - stay
                if gain < least.get(v, gain):
                    continue
                if more > best or (more == best and to is not None and g < to):
                    best, to = more, g
        return to

    queue, waiting, moved = deque(sorted(home)), set(home), set()
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        if (v in far and not may[v]) or (alone and number[home[v]] > 1):
            continue
        to = choice(v)
        if to is not None:
            h, k = home[v], weight[v]
            size[h], size[to], number[h], number[to] = size[h] - k, size[to] + k, number[h] - 1, number[to] + 1
            home[v] = to
            moved.add(v)
            for u, _ in near.get(v, ()):
                if home[u] != to and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
    return moved, choice


def _walked(group: dict, links: list[tuple], weight: dict, resolution: float, total: float, alone: bool, least: dict | None = None) -> dict:
    """Moves until none gains, where all edges ``links`` (node, other, w) of the groups are at hand; ``group`` is changed. Gives the groups' weights."""
    near, size, number = {}, {}, {}
    for v, u, w in links:
        near.setdefault(v, []).append((u, w))
    for v, g in group.items():
        size[g], number[g] = size.get(g, 0.0) + weight[v], number.get(g, 0) + 1
    _walk(group, weight, size, number, {}, near, {}, resolution, total, alone, least)
    return size


def _held(edges: list[tuple], weight: dict, home: dict, resolution: float, total: float) -> dict:
    """Each node's community after all levels, for a graph that fits a task: ``edges`` (node, other, w) both ways, from the communities ``home``."""
    node = {v: v for v in weight}  # of the level

    while True:
        _walked(home, edges, weight, resolution, total, False)
        if len(set(home.values())) == len(home):
            return {v: home[x] for v, x in node.items()}
        part = {v: v for v in home}
        _walked(part, [e for e in edges if home[e[0]] == home[e[1]]], weight, resolution, total, True)
        if all(v == p for v, p in part.items()):
            return node  # no two gain by being together
        names, heavier, between = {}, {}, {}
        for v in sorted(part, key=part.get):
            names.setdefault(home[v], part[v])
            heavier[part[v]] = heavier.get(part[v], 0.0) + weight[v]
        for v, u, w in edges:
            if part[v] != part[u]:
                between[part[v], part[u]] = between.get((part[v], part[u]), 0.0) + w
        node = {v: part[x] for v, x in node.items()}
        home = {part[v]: names[home[v]] for v in part}
        weight, edges = heavier, [(v, u, w) for (v, u), w in between.items()]


def _settled(rows: pd.DataFrame, resolution: float, total: float, alone: bool) -> pd.DataFrame:
    """(node, k, community, group, again) of a task's nodes after its moves.

    ``rows``: of each node itself (kind 0: k, group, size and n of it, go), of its edges into groups by other tasks' nodes (1: group, w, size, n, go: may be joined) and of its
    edges to nodes of the task (2: other, w). With ``alone`` only nodes that are alone in their group move. ``again``: the node, or one of another task because of it, may gain in the next round.
    """
    by = {kind: r for kind, r in rows.groupby("kind")}
    columns = lambda kind, *names: zip(*(by[kind][n].tolist() for n in names), strict=True) if kind in by else ()
    home, weight, kept, may, size, number = {}, {}, {}, {}, {}, {}
    for v, k, c, g, s, n, go in columns(0, "node", "k", "community", "group", "size", "n", "go"):
        home[v], weight[v], kept[v], may[v], size[g], number[g] = g, k, c, go, s, n
    far: dict = {}
    near: dict = {}
    for v, g, w, s, n, go in columns(1, "node", "group", "w", "size", "n", "go"):
        far.setdefault(v, {})[g] = (w, go)
        size.setdefault(g, s)
        number.setdefault(g, n)
    for v, u, w in columns(2, "node", "other", "w"):
        near.setdefault(v, []).append((u, w))

    moved, choice = _walk(home, weight, size, number, far, near, may, resolution, total, alone)
    again = [v in far and (v in moved or ((not alone or number[home[v]] == 1) and choice(v) is not None)) for v in home]
    return pd.DataFrame({"node": list(home), "k": [weight[v] for v in home], "community": [kept[v] for v in home], "group": list(home.values()), "again": again})


def _apart(edges: DataFrame, sized: DataFrame, task: Callable[[str], Column], resolution: float, total: float) -> DataFrame:
    """(task, node, group, w, size, n): the weight of each node's edges into groups by nodes of other tasks; its own group and the ``CHOICES`` of greatest gain."""
    there = sized.select(F.col("node").alias("other"), "group", "size", "n")
    linked = dealt_join(edges, there, ["other"], "node").withColumns({"task": task("node"), "__theirs": task("other")}).filter("task <> __theirs")
    apart = linked.groupBy("task", "node", "group").agg(F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("k", "size", "n")])
    own = sized.select("node", F.col("group").alias("__home"))
    best = Window.partitionBy("node").orderBy(F.desc(F.col("w") - resolution * F.col("k") * F.col("size") / total), "group")
    chosen = apart.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= CHOICES).drop("rank").join(own, "node").filter("group <> __home")
    return chosen.unionByName(dealt_join(apart, own, ["node"], "group").filter("group = __home"))


def _turns(edges: DataFrame, now: DataFrame, alone: bool, resolution: float, total: float, tasks: int, max_rounds: int) -> DataFrame:
    """Rounds over nodes (node, k, community, group) until none gains; see the module."""
    kind = dict(now.dtypes)["node"]
    schema = f"node {kind}, k double, community {kind}, group {kind}, again boolean"
    task = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(tasks))
    for turn in range(max_rounds):
        sizes = now.groupBy("group").agg(F.sum("k").alias("size"), F.count("*").alias("n"))
        sized = dealt_join(now.select("node", "k", "community", "group"), sizes, ["group"], "node")
        # no nulls, which would make ids doubles in pandas
        none = lambda *names: [(F.lit(0.0) if c in ("k", "w", "size") else F.lit(0).cast("long") if c == "n" else F.lit(False) if c == "go" else F.col("node")).alias(c) for c in names]
        rows = sized.select(task("node").alias("task"), F.lit(0).alias("kind"), "node", "k", "community", "group", "size", "n", _active("node", turn).alias("go"), *none("other", "w"))
        within = edges.withColumns({"task": task("node"), "__theirs": task("other")}).filter("task = __theirs")
        rows = rows.unionByName(within.select("task", F.lit(2).alias("kind"), "node", "other", "w", *none("k", "community", "group", "size", "n", "go")))
        if tasks > 1:  # one task has no edges to others
            apart = _apart(edges, sized, task, resolution, total)
            open_ = (F.col("n") > 1) | ~_active("group", turn) if alone else F.lit(True)
            rows = rows.unionByName(apart.select("task", F.lit(1).alias("kind"), "node", "group", "w", "size", "n", open_.alias("go"), *none("k", "community", "other")))
        after = materialize(rows.groupBy("task").applyInPandas(lambda df: _settled(df, resolution, total, alone), schema), "moves")
        done = after.filter("again").isEmpty()
        drop_table(now)
        now = after
        if done:
            break
    return now


def _regions(units: DataFrame, links: DataFrame, count: int, wanted: int, turn: int) -> DataFrame:
    """(unit, n, region) of units (unit, n): about ``wanted`` regions that grow from units chosen by a hash, each unit joining the region that its edges (unit, other, w) weigh most into. Those out of reach go by a hash."""
    seed = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(max(1, count // wanted))) == 0
    now, left = materialize(units.select("unit", "n", F.when(seed, F.xxhash64("unit")).alias("region")), "regions"), count
    for _ in range(STEPS):
        waiting = dealt_join(links, now.filter("region IS NULL").select("unit"), ["unit"], "other")
        met = dealt_join(waiting, now.filter("region IS NOT NULL").select(F.col("unit").alias("other"), "region"), ["other"], "unit")
        best = met.groupBy("unit", "region").agg(F.sum("w").alias("w")).groupBy("unit").agg(F.max(F.struct("w", "region")).alias("m"))
        after = materialize(now.join(best, "unit", "left").select("unit", "n", F.coalesce("region", "m.region").alias("region")), "regions")
        drop_table(now)
        now, before, left = after, left, after.filter("region IS NULL").count()
        if left == before or left * 50 < count:
            break
    return now.withColumn("region", F.coalesce("region", F.pmod(F.xxhash64("unit"), F.lit(wanted))))


def _blocks(edges: DataFrame, nodes: DataFrame, tasks: int, chunk: int, turn: int) -> DataFrame:
    """(node, k, community, whole, block, piece): nodes dealt to blocks of about ``chunk`` edges, by whole communities. ``whole`` is false where a community alone is larger; its nodes go by a hash."""
    degree = edges.groupBy("node").agg(F.count("*").alias("n"))
    held = materialize(nodes.select("node", "k", "community").join(degree, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))), "held")
    units = materialize(held.groupBy(F.col("community").alias("unit")).agg(F.sum("n").alias("n")), "units")
    count = units.count()
    if count == held.count():  # nodes alone, which name their communities
        links, written = edges.select(F.col("node").alias("unit"), "other", "w"), None
    else:
        of = held.select("node", F.col("community").alias("unit"))
        ends = dealt_join(edges.select("node", "other", "w"), of, ["node"], "other").drop("node")
        ends = dealt_join(ends, of.select(F.col("node").alias("other"), F.col("unit").alias("their")), ["other"], "unit").filter("unit <> their")
        links = written = materialize(ends.groupBy("unit", F.col("their").alias("other")).agg(F.sum("w").alias("w")), "unit-links")
    regions = _regions(units, links, count, REGIONS * tasks, turn)
    # a row for each region
    sizes = regions.groupBy("region").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select("region", F.floor(F.coalesce(before, F.lit(0)) / chunk).alias("block"), F.ceil(F.col("size") / chunk).alias("pieces"))
    dealt = dealt_join(regions, placed, ["region"], "unit").select(F.col("unit").alias("community"), "block", F.greatest("pieces", F.lit(1)).alias("pieces"), (F.col("n") <= chunk).alias("whole"))
    piece = F.pmod(F.when(F.col("whole"), F.xxhash64("community")).otherwise(F.xxhash64("node", F.lit(turn))), F.col("pieces"))
    out = materialize(dealt_join(held, dealt, ["community"], "node").select("node", "k", "community", "whole", "block", piece.alias("piece")), "blocks")
    for t in (held, units, regions, *([] if written is None else [written])):
        drop_table(t)
    return out


def _within(rows: pd.DataFrame, resolution: float, total: float) -> pd.DataFrame:
    """(node, k, community, part) after the moves and the refinement of one block: ``rows`` of its nodes (other = node; w: the node's weight; far: what it would gain in a community of another block) and of its edges.

    A node that would gain more elsewhere joins nothing here and is a part of its own, so that it can go there in the next level.
    """
    rows = rows.sort_values(["node", "other"])
    own, links = rows[rows["other"] == rows["node"]], rows[rows["other"] != rows["node"]]
    home, weight, whole, far = (dict(zip(own["node"].tolist(), own[c].tolist(), strict=True)) for c in ("community", "w", "whole", "far"))
    edges = list(zip(*(links[c].tolist() for c in ("node", "other", "w")), strict=True))
    group = {v: c for v, c in home.items() if whole[v]}
    size = _walked(group, [e for e in edges if whole[e[0]] and whole[e[1]]], weight, resolution, total, False, far)
    home |= group
    inner = [e for e in edges if home[e[0]] == home[e[1]]]
    stay = {v: -resolution * weight[v] * (size[g] - weight[v]) / total for v, g in group.items()}
    for v, _, w in inner:
        if v in stay:
            stay[v] += w
    loose = {v for v, gain in stay.items() if far[v] > gain + LEAST_GAIN * weight[v]}
    part = {v: v for v in home}
    held = {v: v for v in home if v not in loose}
    _walked(held, [e for e in inner if e[0] not in loose and e[1] not in loose], weight, resolution, total, True)
    part |= held
    return pd.DataFrame({"node": list(home), "k": [weight[v] for v in home], "community": list(home.values()), "part": [part[v] for v in home]})


def _in_blocks(edges: DataFrame, nodes: DataFrame, tasks: int, chunk: int, turn: int, resolution: float, total: float) -> DataFrame:
    """(node, k, community, part): one pass of moves and refinement over nodes (node, k, community), each block a task."""
    kind = dict(nodes.dtypes)["node"]
    dealt = placed = _blocks(edges, nodes, tasks, chunk, turn)
    place = dealt.select("node", F.struct("block", "piece").alias("at"), "community")
    linked = dealt_join(edges.select("node", "other", "w"), place, ["node"], "other")
    linked = dealt_join(linked, place.select(F.col("node").alias("other"), F.col("at").alias("theirs"), F.col("community").alias("there")), ["other"], "node")
    linked = materialize(linked, "linked")
    near = linked.filter("at = theirs")
    # what a node would gain in the best community of other blocks
    sizes = dealt.groupBy(F.col("community").alias("there")).agg(F.sum("k").alias("size"))
    apart = linked.filter("at <> theirs AND community <> there").groupBy("node", "there").agg(F.sum("w").alias("w"))
    apart = dealt_join(dealt_join(apart, sizes, ["there"], "node"), dealt.select("node", "k"), ["node"], "there")
    far = apart.groupBy("node").agg(F.max(F.col("w") - resolution * F.col("k") * F.col("size") / total).alias("far"))
    dealt = dealt.join(far, "node", "left").withColumn("far", F.coalesce("far", F.lit(float("-inf"))))
    # a node's own row has itself as the other end, as no edge has
    rows = dealt.select("block", "piece", "node", F.col("node").alias("other"), F.col("k").alias("w"), "community", "whole", "far")
    rows = rows.unionByName(near.select("at.block", "at.piece", "node", "other", "w", F.col("node").alias("community"), F.lit(True).alias("whole"), F.lit(0.0).alias("far")))
    out = materialize(rows.groupBy("block", "piece").applyInPandas(lambda df: _within(df, resolution, total), f"node {kind}, k double, community {kind}, part {kind}"), "parts")
    drop_table(placed)
    drop_table(linked)
    return out


def modularity(graph: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (id, community) on a graph (id, other, weight) that holds both directions of each edge."""
    a, b = (communities.select(F.col("id").alias(n), F.col("community").alias(f"c_{n}")) for n in ("id", "other"))
    edges = dealt_join(dealt_join(graph.filter("id <> other").select("id", "other", "weight"), a, ["id"], "other"), b, ["other"], "id")
    by = edges.groupBy(F.col("c_id").alias("c")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("c_id") == F.col("c_other"), F.col("weight")).otherwise(0.0)).alias("inside"))
    row = by.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return float(row[1] / row[0] - resolution * row[2] / row[0] ** 2) if row[0] else 0.0


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends share a community."""
    a = nodes.select("node", F.col("group").alias("ours"))
    b = nodes.select(F.col("node").alias("other"), F.col("group").alias("theirs"))
    return dealt_join(dealt_join(edges, a, ["node"], "other"), b, ["other"], "node").filter("ours = theirs").select("node", "other", "w", "k")


def leiden(graph: DataFrame, resolution: float = 1.0, iterations: int = 2, max_levels: int = 30, max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(id, community): communities of a graph (id, other, weight), each named by its smallest node. Every community is connected.

    ``graph`` holds both directions of each edge; repeated edges add up; loops, null ends and weights that aren't above zero are ignored, and so are nodes without other edges. An empty graph
    gives an empty result. Each of ``iterations`` begins with the communities of the one before, and lowers no modularity. The result doesn't hang on the order of rows (but for the rounding of sums).
    """
    clean = graph.select(F.col("id").alias("node"), "other", F.col("weight").cast("double").alias("w")).filter("node IS NOT NULL AND other IS NOT NULL AND node <> other AND w > 0")
    summed = materialize(clean.groupBy("node", "other").agg(F.sum("w").alias("w")), "leiden-edges")
    total = summed.agg(F.sum("w")).first()[0]
    own = summed.groupBy("node").agg(F.sum("w").alias("k")).select("node", "k", F.col("node").alias("community"))
    if not total:
        return own.select(F.col("node").alias("id"), "community")
    weighed = lambda e, n: materialize(dealt_join(e, n.select("node", "k"), ["node"], "other").select("node", "other", "w", "k"), "leiden-edges")
    start = materialize(own, "moves")
    original = weighed(summed, start)
    tasks = lambda e: max(1, -(-e.count() // chunk))
    drop_table(summed)
    for turn in range(iterations):
        found = _iteration(original, start, resolution, total, tasks, weighed, max_levels, max_rounds, chunk, turn)
        start = materialize(dealt_join(start.drop("community"), found.withColumnRenamed("id", "node"), ["node"], "k"), "moves")
    return start.select(F.col("node").alias("id"), "community")


def _iteration(original: DataFrame, start: DataFrame, resolution: float, total: float, tasks: Callable, weighed: Callable, max_levels: int, max_rounds: int, chunk: int, turn: int) -> DataFrame:
    """(id, community) after all levels, from the communities of ``start`` (node, k, community)."""
    edges, nodes, names = original, start, None  # names: (id, node of the level)
    kind, apart = dict(start.dtypes)["node"], False
    for level in range(max_levels):
        if (dealt := tasks(edges)) == 1:
            # what fits a task is finished in one

            def rest(df):
                own, links = df[df["other"] == df["node"]], df[df["other"] != df["node"]].sort_values(["node", "other"])
                of = _held(list(zip(*(links[c].tolist() for c in ("node", "other", "w")), strict=True)), *(dict(zip(own["node"].tolist(), own[c].tolist(), strict=True)) for c in ("w", "community")), resolution, total)
                return pd.DataFrame({"node": list(of), "community": list(of.values())})

            # a node's own row has itself as the other end, as no edge has
            rows = nodes.select("node", F.col("node").alias("other"), F.col("k").alias("w"), "community").union(edges.select("node", "other", "w", F.col("node")))
            nodes, apart = materialize(rows.groupBy(F.lit(0).alias("__one")).applyInPandas(rest, f"node {kind}, community {kind}"), "moves"), True
            break
        parts = parts_table = _in_blocks(edges, nodes, dealt, chunk, turn * max_levels + level, resolution, total)
        if parts.filter("node <> part").count() * 10 < parts.count():
            drop_table(parts)
            moved = _turns(edges, nodes.withColumn("group", F.col("community")), False, resolution, total, dealt, max_rounds)
            if nodes is not start:
                drop_table(nodes)
            apart = moved.agg(F.count("*") - F.count_distinct("group")).first()[0] == 0
            if apart:
                nodes = moved.select("node", "k", F.col("group").alias("community"))
                break
            inner = materialize(_inside(edges, moved), "inside")
            parts = _turns(inner, moved.select("node", "k", F.col("group").alias("community"), F.col("node").alias("group")), True, resolution, total, tasks(inner), max_rounds)
            drop_table(inner)
            parts_table, parts = parts, parts.select("node", "k", "community", F.col("group").alias("part"))
            drop_table(moved)
            if parts.filter("node <> part").isEmpty():
                # no two nodes gain by being together, so what the level before left in one community comes apart
                apart, nodes = True, parts.select("node", "k", F.col("node").alias("community"))
                break
        elif nodes is not start:
            drop_table(nodes)
        of = parts.select("node", "part")
        step = of.select(F.col("node").alias("id"), F.col("part").alias("node")) if names is None else dealt_join(names, of, ["node"], "id").select("id", F.col("part").alias("node"))
        names_ = materialize(step, "names")
        near = dealt_join(edges.select("node", "other", "w"), of.withColumnRenamed("part", "a"), ["node"], "other")
        near = dealt_join(near, of.select(F.col("node").alias("other"), F.col("part").alias("b")), ["other"], "node")
        between = near.filter("a <> b").groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("w").alias("w"))
        # a part keeps all its nodes' weight, and a community is named by one of its parts
        fresh = parts.groupBy("part").agg(F.sum("k").alias("k"), F.min("community").alias("old"))
        names_of = fresh.groupBy("old").agg(F.min("part").alias("community"))
        nodes_ = materialize(dealt_join(fresh, names_of, ["old"], "part").select(F.col("part").alias("node"), "k", "community"), "moves")
        edges_ = weighed(between, nodes_)
        for t in (parts_table, *([] if names is None else [names]), *([] if edges is original else [edges])):
            drop_table(t)
        nodes, names, edges = nodes_, names_, edges_
    if names is None:
        found = nodes.select(F.col("node").alias("id"), "community")
    else:
        found = materialize(dealt_join(names, nodes.select("node", "community"), ["node"], "id").select("id", "community"), "communities")
    if not apart:  # stopped early: a community may still lie in pieces
        inside = _inside(original, found.select(F.col("id").alias("node"), F.col("community").alias("group")))
        pieces = connected_components(inside, "node", "other").select(F.col("node").alias("id"), "component")
        found = found.join(pieces, "id", "left").select("id", F.coalesce("component", "id").alias("community"))
    least = found.groupBy("community").agg(F.min("id").alias("least"))
    return dealt_join(found, least, ["community"], "id").select("id", F.col("least").alias("community"))
