import random

import pytest

from meshloom.operators import graph, morse


def naive_components(edges):
    up = {}
    for a, b in edges:
        a, b = graph.find_root(up, a), graph.find_root(up, b)
        up[max(a, b)] = min(a, b)
    return {x: graph.find_root(up, x) for e in edges for x in e}


@pytest.fixture(params=[True, False], ids=["together", "apart"])
def spread(spark, request):
    """Rows of small tables in one task, or spread over several; also how many rows a task takes together."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(request.param).lower())
    yield graph.CHUNK if request.param else 8
    spark.conf.unset(name)


def test_components(spark, spread):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(i, i + 1) for i in range(100, 125)]
    df = spark.createDataFrame(edges + [(None, 1), (5, None), (7, 7)], "a long, b long")
    got = {row.node: row.component for row in graph.connected_components(df, chunk=spread).collect()}
    want = naive_components([e for e in edges if e[0] != e[1]])
    assert got == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_components_keep_keys_apart(spark):
    df = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("q", 2, 5)], "s string, a long, b long")
    got = {(r.s, r.node): r.component for r in graph.connected_components(df, keys=("s",)).collect()}
    assert got == {("p", 1): 1, ("p", 2): 1, ("p", 3): 1, ("q", 2): 2, ("q", 5): 2}


def test_hub_and_long_path(spark, spread):
    """A hub of 100,000 neighbours and a path of 10,000 nodes in a random order."""
    order = list(range(200_000, 210_000))
    random.Random(4).shuffle(order)
    hub = spark.range(1, 100_001).selectExpr("50000 AS a", "id AS b")
    path = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = graph.connected_components(hub.union(path), chunk=max(spread, 20_000)).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {1: 100_000, 200_000: 10_000}
    tree = spark.createDataFrame([(0, x, y) for x, y in zip(order, [None, *order])], "sample int, node long, parent long")
    flat = spark.range(100_000).selectExpr("0 AS sample", "id AS node", "CASE WHEN id = 7 THEN NULL WHEN id = 9 THEN 7 ELSE 9 END AS parent")
    both = tree.union(flat)
    roots = graph.resolve_roots(both, ["sample"], chunk=max(spread, 20_000)).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in roots} == {order[0]: 10_000, 7: 100_000}
    starts = spark.createDataFrame([(0, order[-1]), (0, 3)], "sample int, node long")
    assert morse.trace_up(both, starts, chunk=max(spread, 20_000)).count() == 10_000 + 3


def test_roots_and_paths(spark, spread):
    rows = [(0, i, i - 1 if i % 10 else None, i) for i in range(30)]
    tree = spark.createDataFrame(rows, "sample int, node long, parent long, parent_edge long")
    got = {r.node: r.root for r in graph.resolve_roots(tree, ["sample"], chunk=spread).collect()}
    assert got == {i: i - i % 10 for i in range(30)}
    starts = spark.createDataFrame([(0, 7), (0, 23)], "sample int, node long")
    assert {r.node for r in morse.trace_up(tree, starts, chunk=spread).collect()} == {*range(8), 20, 21, 22, 23}


def test_degrees_and_adjacency(spark):
    df = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3)], "sample int, a long, b long")
    assert {(r.a, r.b) for r in graph.symmetric(df, "a", "b", "sample").collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert {r.node: r.degree for r in graph.degrees(df, "a", "b", "sample").collect()} == {1: 2, 2: 3, 3: 1}


def test_shortest_paths(spark, spread):
    """Against Dijkstra's rule, with lengths of zero, ties, repeated and null edges, and nodes that can't be reached."""
    import heapq

    r = random.Random(8)
    edges = [("p", r.randrange(30), r.randrange(30), float(r.randrange(4))) for _ in range(60)] + [("q", 1, 2, 5.0), ("q", 2, 3, 1.0), ("q", 7, 8, 1.0)]
    df = spark.createDataFrame([*edges, edges[0], ("p", None, 1, 1.0), ("p", 2, 3, None)], "s string, a long, b long, w double")
    near = {}
    for s, a, b, w in edges:
        near.setdefault((s, a), []).append((w, b))
        near.setdefault((s, b), []).append((w, a))
    sources, want = [("p", 0), ("p", 5), ("q", 1)], {}
    heap = [(0.0, x) for x in sources]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in want:
            want[x] = d
            for w, y in near.get(x, []):
                heapq.heappush(heap, (d + w, (x[0], y)))
    got = graph.shortest_paths(df, spark.createDataFrame(sources, "s string, node long"), weight="w", keys=("s",)).collect()
    assert {(x.s, x.node): x.distance for x in got} == want
    for x in got:
        if x.previous is not None:
            step = min(w for w, b in near[(x.s, x.previous)] if b == x.node)
            assert want[(x.s, x.previous)] + step == x.distance
    assert {(x.s, x.node) for x in got if x.previous is None} == set(sources)
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "a long, b long, w double"), spark.createDataFrame([(1,)], "node long"), weight="w")
    assert graph.shortest_paths(df.limit(0), spark.createDataFrame([("p", 3)], "s string, node long"), keys=("s",)).count() == 1


def test_adjacency_keeps_isolated_nodes(spark):
    nodes = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "sample int, node long")
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 3)], "sample int, x long, y long")
    got = {tuple(r) for r in graph.adjacency(nodes, edges, "x", "y", "sample").collect()}
    assert got == {(0, 1, 2), (0, 2, 1), (0, 3, None), (1, 1, None)}


@pytest.mark.parametrize("chunk", [graph.CHUNK, 100])
def test_long_paths_of_keys_that_fit_a_task(spark, monkeypatch, chunk):
    """One pass for keys that fit a task, rounds for the others; equal distances, and the smaller node before."""
    written = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="step": (written.append(name), write(df, name))[1])
    far = 1 << 60  # ids that no double holds
    rows = [("long", far + i, far + i + 1) for i in range(40)] + [("wide", 0, i) for i in range(1, 80)] + [("wide", i, 100) for i in range(1, 80)] + [(None, 1, 2)]
    sources = spark.createDataFrame([("long", far), ("wide", 0), ("wide", None), ("none", 5)], "s string, node long")
    got = graph.shortest_paths(spark.createDataFrame(rows, "s string, a long, b long"), sources, keys=("s",), **({"chunk": chunk} if chunk < graph.CHUNK else {})).collect()
    want = {("long", far + i): (float(i), far + i - 1 if i else None) for i in range(41)} | {("wide", i): (1.0, 0) for i in range(1, 80)} | {("wide", 0): (0.0, None), ("wide", 100): (2.0, 1), ("none", 5): (0.0, None)}
    assert {(x.s, x.node): (x.distance, x.previous) for x in got} == want
    assert len(written) < 10
