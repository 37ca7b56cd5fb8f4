"""Communities, layouts, neighbour lists and ranks: against plain versions, quality bounds, odd rows."""

import numpy as np
import pytest

from meshloom.operators import analysis, community, layout, neighbours
from meshloom.operators.graph import ranked

GRAPH = "id long, other long, weight double"


def louvain(graph: list[tuple[int, int, float]], resolution: float = 1.0) -> dict[int, int]:
    """Communities of an undirected weighted graph by greedy modularity, nodes in ascending order; numbered by their smallest member."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in graph:
        if a != b:
            near.setdefault(a, {})[b] = w
            near.setdefault(b, {})[a] = w
    member, loops = {v: [v] for v in near}, dict.fromkeys(near, 0.0)
    while True:
        weight = {v: sum(n.values()) + loops[v] for v, n in near.items()}
        total = sum(weight.values()) or 1.0
        home, size, moved = {v: v for v in near}, dict(weight), False
        for _ in range(50):
            changed = False
            for v in sorted(near):
                size[home[v]] -= weight[v]
                pull: dict[int, float] = {home[v]: 0.0}
                for u, w in near[v].items():
                    pull[home[u]] = pull.get(home[u], 0.0) + w
                gain = {c: p - resolution * weight[v] * size[c] / total for c, p in pull.items()}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c))
                if gain[best] <= gain[home[v]] + 1e-12:
                    best = home[v]
                changed |= best != home[v]
                home[v] = best
                size[best] += weight[v]
            moved |= changed
            if not changed:
                break
        if not moved:
            groups = sorted(member.values(), key=min)
            return {v: i for i, g in enumerate(groups) for v in g}
        name = {c: min(v for v in near if home[v] == c) for c in set(home.values())}
        new_near: dict[int, dict[int, float]] = {n: {} for n in name.values()}
        new_loops, new_member = dict.fromkeys(new_near, 0.0), {n: [] for n in new_near}
        for v, n in near.items():
            c = name[home[v]]
            new_member[c] += member[v]
            new_loops[c] += loops[v]
            for u, w in n.items():
                d = name[home[u]]
                if c == d:
                    new_loops[c] += w
                else:
                    new_near[c][d] = new_near[c].get(d, 0.0) + w
        near, loops, member = new_near, new_loops, new_member


def both(links):
    return [(a, b, float(w)) for a, b, w in links] + [(b, a, float(w)) for a, b, w in links]


def modularity(links, of):
    total = 2 * sum(w for _, _, w in links)
    k, inside = {}, 0.0
    for a, b, w in links:
        k[of[a]] = k.get(of[a], 0.0) + w
        k[of[b]] = k.get(of[b], 0.0) + w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - sum(v * v for v in k.values()) / total**2


def connected(links, of):
    near = {}
    for a, b, _ in links:
        if of[a] == of[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(of.values()):
        members = {v for v in of if of[v] == c}
        seen, stack = set(), [min(members)]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                stack += near.get(v, ())
        if seen != members:
            return False
    return True


def random_links(seed, n=240, groups=6):
    r = np.random.default_rng(seed)
    kind = r.integers(0, groups, n)
    links = {}
    for a in range(n):
        for b in r.choice(n, 10, replace=False):
            if a != b and (kind[a] == kind[b] or r.random() < 0.12):
                links[(min(a, b), max(a, b))] = r.random() + 0.1
    for a in range(1, 60):  # a hub
        links[(0, a)] = 0.3
    return [(int(a), int(b), float(w)) for (a, b), w in links.items()]


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_are_connected_and_as_good_as_louvain(spark, seed):
    links = random_links(seed)
    df = spark.createDataFrame(both(links), GRAPH)
    found = community.leiden(df)
    of = {r.id: r.community for r in found.collect()}
    assert set(of) == {x for a, b, _ in links for x in (a, b)} and connected(links, of)
    assert all(of[c] == c and c == min(v for v in of if of[v] == c) for c in set(of.values()))
    mine, plain = modularity(links, of), modularity(links, louvain(sorted(links)))
    assert mine >= plain - 1e-9
    assert community.modularity(df, found) == pytest.approx(mine, abs=1e-9)


def test_communities_over_many_tasks(spark):
    links = random_links(3, 120, 4)
    far = 1 << 60  # ids that no double holds
    df = spark.createDataFrame(both([(a + far, b + far, w) for a, b, w in links]), GRAPH)
    of = {r.id - far: r.community - far for r in community.leiden(df, iterations=1, chunk=500).collect()}
    assert connected(links, of) and modularity(links, of) >= modularity(links, louvain(sorted(links))) - 0.02


def test_communities_of_odd_graphs(spark):
    rows = [(1, 2, 1.0), (2, 1, 1.0), (2, 2, 5.0), (3, 4, 0.5), (4, 3, 0.5), (3, 4, 0.5), (4, 3, 0.5), (5, 6, 0.0), (6, 5, -1.0), (None, 1, 1.0), (7, None, 1.0), (8, 9, None)]
    assert {tuple(r) for r in community.leiden(spark.createDataFrame(rows, GRAPH)).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert community.leiden(spark.createDataFrame([], GRAPH)).collect() == []
    named = analysis.communities(spark.createDataFrame(rows, GRAPH))
    assert sorted(map(tuple, named.collect())) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def planted(n=300, d=6, seed=0, groups=5):
    r = np.random.default_rng(seed)
    kind = r.integers(0, groups, n)
    return kind, 3 * np.eye(d)[kind] + r.normal(0, 0.5, (n, d))


def trustworthiness(x, y, k=10):
    """Share of near neighbours in the layout that are near in truth, by ranks."""
    n = len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    rank = d.argsort(axis=1).argsort(axis=1) + 1
    e = ((y[:, None] - y) ** 2).sum(axis=2)
    np.fill_diagonal(e, np.inf)
    bad = sum(max(0, rank[i, j] - k) for i in range(n) for j in e[i].argsort()[:k])
    return 1 - 2 * bad / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("block", [layout.BLOCK, 80])
def test_layout_keeps_neighbours(spark, block):
    kind, x = planted()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    got = {r.id: r.at for r in layout.umap(analysis.fuzzy_graph(analysis.knn(df, 10)), epochs=120, rounds=6, block=block).collect()}
    y = np.array([got[i] for i in range(300)])
    assert np.isfinite(y).all() and trustworthiness(x, y) > 0.9
    near = ((y[:, None] - y) ** 2).sum(axis=2).argsort(axis=1)[:, 1:6]
    assert (kind[near] == kind[:, None]).mean() > 0.95


def test_curve_of_known_settings():
    assert layout.curve(1.0, 0.1) == pytest.approx((1.577, 0.8951), abs=1e-3)
    a, b = layout.curve(2.0, 0.5)
    d = np.linspace(0, 6, 50)[1:]
    assert np.abs(1 / (1 + a * d ** (2 * b)) - np.where(d < 0.5, 1, np.exp(-(d - 0.5) / 2))).max() < 0.1


def test_edges_are_due_by_weight():
    import pandas as pd

    rows = pd.DataFrame({"node": [0, 1, 2, 3], "at": [[0.0, 0.0], [4.0, 0.0], [0.0, 9.0], [4.0, 9.0]], "other": [1, 0, 3, 2], "w": [1.0, 1.0, 0.1, 0.1]})
    rows["there"] = rows["other"].map(dict(zip(rows["node"], rows["at"], strict=True)))
    out = layout.epochs_of(rows, np.array([[1e6, 1e6]]), 10**9, 1.5, 0.9, 0, 9, 10, 1.0, 1, 0.5, (0, 0))
    at = dict(zip(out["node"], out["at"], strict=True))
    assert np.linalg.norm(np.subtract(at[0], at[1])) < 3 and np.linalg.norm(np.subtract(at[2], at[3])) == 4  # a tenth of the weight: not due within nine epochs


def test_layout_of_odd_graphs(spark):
    rows = [(1, 2, 1.0), (2, 1, 1.0), (2, 2, 5.0), (5, 6, 0.0), (None, 1, 1.0)]
    got = layout.umap(spark.createDataFrame(rows, GRAPH), epochs=20, rounds=2, start_rounds=3).collect()
    assert {r.id for r in got} == {1, 2} and all(np.isfinite(r.at).all() for r in got)
    assert layout.umap(spark.createDataFrame([], GRAPH)).collect() == []


@pytest.mark.parametrize(("n", "d", "k"), [(1500, 8, 10), (900, 5, 20), (40, 3, 60)])
def test_descent_recalls_exact_neighbours(spark, n, d, k):
    _, x = planted(n, d, seed=n, groups=3)
    x[: n // 3] = x[0]  # a third are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>").repartition(3)
    found, exact = neighbours.descend(df, k).cache(), analysis.knn(df, k).cache()
    assert neighbours.recall(found, exact, k) >= 0.95 and found.count() == exact.count() == n * min(k, n - 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in found.filter("id % 97 = 1").collect():
        assert r.id != r.other and r.distance == pytest.approx(1 - u[r.id] @ u[r.other], abs=1e-9)


def test_descent_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.1]), (None, [1.0, 1.0]), (5, None)]
    got = {(r.id, r["rank"]): (r.other, round(r.distance, 3)) for r in neighbours.descend(spark.createDataFrame(rows, "id long, emb array<double>"), 2).collect()}
    assert got == {(1, 1): (3, 0.005), (1, 2): (2, 1.0), (2, 1): (1, 1.0), (2, 2): (3, 1.0), (3, 1): (1, 0.005), (3, 2): (2, 1.0)}
    assert neighbours.descend(spark.createDataFrame([], "id long, emb array<double>"), 2).collect() == []


def test_ranks_within_keys(spark):
    r = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else int(i % 2 and 5), int(x), i) for i, x in enumerate(r.integers(0, 1000, 800))]
    got = ranked(spark.createDataFrame(rows, "key long, x long, i long").repartition(5), ["key"], ["x", "i"]).collect()
    want = {}
    for key in (None, 0, 5):
        for place, row in enumerate(sorted((x, i) for k, x, i in rows if k == key), 1):
            want[row[1]] = place
    assert {g.i: g["rank"] for g in got} == want
    assert ranked(spark.createDataFrame([], "key long, x long"), ["key"], ["x"]).collect() == []


def test_communities_in_blocks_need_no_rounds(spark, monkeypatch):
    """A graph larger than a task goes in passes over blocks, and is as good as one in a task but for little."""

    def rounds(*_):
        raise AssertionError("rounds over tasks")

    monkeypatch.setattr(community, "_turns", rounds)
    links = random_links(3)
    of = {r.id: r.community for r in community.leiden(spark.createDataFrame(both(links), GRAPH), chunk=900).collect()}
    assert set(of) == {x for a, b, _ in links for x in (a, b)} and connected(links, of)
    assert modularity(links, of) >= modularity(links, louvain(sorted(links))) - 0.02


def test_nodes_that_gain_elsewhere_stay_alone():
    """In its block node 1 could only join 2; it would gain more in another block, so it is a part of its own."""
    import pandas as pd

    rows = [(v, v, 2.0, v, True, 0.9 if v == 1 else -np.inf) for v in (1, 2, 3)] + [(a, b, w, a, True, 0.0) for a, b, w in both([(1, 2, 0.5), (2, 3, 1.5)])]
    out = community._within(pd.DataFrame(rows, columns=["node", "other", "w", "community", "whole", "far"]), 1.0, 100.0).set_index("node")
    assert out["part"][1] == 1 and out["community"][1] == 1 and out["part"][2] == out["part"][3]
