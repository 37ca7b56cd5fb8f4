"""Embedding near-duplicates through hierarchical navigable small-world graphs.

Vectors are compared within a label only. A label's vectors are dealt into shards of about ``SHARD``. Each shard's graph is built once and
written to the shared folder; it is queried with the shard's own vectors and with those of every later shard of the label, a shard at a time. A search runs in
lockstep for a block of queries: greedy descent through the upper levels, a beam on the lowest, and then the beam is
widened by every neighbour of a link, whichever way, until no link is new. Two samples audit the beam: queries against all vectors of
the shard, and planted ones, each a vector of the shard turned until it is barely a link, which must find that vector though nothing else is near. While the recall of
either is too low the beam doubles; past a share of the shard, every query meets all its vectors instead. Links are verified by cosine in double
precision. Copies of a vector are one node with a weight. Kernels return counts and stars, not pairs; components are then united.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import star
from meshloom.llm.vectors import folded, matrix, usable
from meshloom.operators.graph import connected_components, dealt_join
from meshloom.plans.storage import drop_table, materialize

#: Vectors in a shard at most, and bytes of them.
SHARD, SHARD_BYTES, THRESHOLD = 16_384, 32 << 20, 0.93
#: Links of a node on upper levels and on the lowest, beam when building and at first when searching, expansions a step.
M, M0, BUILD, BEAM, AT_ONCE, BLOCK = 8, 16, 32, 32, 4, 512
FRONTIER = 65_536
AUDITED, PLANTED, RECALL, SLACK = 96, 512, 0.999, 1e-4
#: Share of a shard beyond which a beam costs more than all vectors.
WIDEST = 1 / 16


class Graph:
    """A navigable small world over unit vectors; similarity is the dot product."""

    def __init__(self, unit: np.ndarray, seed: int = 1):
        self.x = unit.astype(np.float32)
        self._both = None
        n = len(unit)
        r = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - r.random(n)) / np.log(M)).astype(int), 6)
        self.links = [np.full((n, M if level else M0), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
        order = r.permutation(n)
        order = np.concatenate([order[levels[order] == levels.max(initial=0)][:1], order]) if n else order
        order = order[np.sort(np.unique(order, return_index=True)[1])]
        self.entry, self.levels = int(order[0]) if n else -1, levels
        at = 1
        while at < n:
            step = min(BLOCK, max(8, at // 2), n - at)
            self._insert(order[at : at + step])
            at += step

    @classmethod
    def of(cls, unit: np.ndarray, links: list[np.ndarray], levels: np.ndarray, entry: int) -> Graph:
        """A graph that was built before."""
        out = cls.__new__(cls)
        out.x, out.links, out.levels, out.entry, out._both = unit.astype(np.float32), links, levels, entry, None
        return out

    def _sims(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, np.einsum("qkd,qd->qk", self.x[ids], q), -np.inf)

    def search(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of a beam for each query, best first; ``start``: ids to begin with, a row each."""
        links, n = self.links[level], len(q)
        ids = np.full((n, beam), -1, np.int64)
        start = np.sort(start, axis=1)
        start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
        k = min(beam, start.shape[1])
        ids[:, :k] = start[:, :k]
        sims, done = self._sims(ids, q), ids < 0
        seen = np.zeros((n, len(self.x)), bool)
        rows, cols = np.nonzero(ids >= 0)
        seen[rows, ids[rows, cols]] = True
        live = np.arange(n)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_sims, min(AT_ONCE, beam) - 1, axis=1)[:, : min(AT_ONCE, beam)]
            ok = np.take_along_axis(open_sims, pick, 1) > -np.inf
            keep = ok.any(axis=1)
            live, pick, ok = live[keep], pick[keep], ok[keep]
            if not len(live):
                break
            node = ids[live[:, None], pick]
            done[live[:, None], pick] = True
            near = np.where(ok[:, :, None], links[node], -1).reshape(len(live), -1).astype(np.int64)
            near[(near >= 0) & seen[live[:, None], near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            a, b = np.nonzero(near >= 0)
            seen[live[a], near[a, b]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[a, b] = np.einsum("kd,kd->k", self.x[near[a, b]], q[live[a]])
            all_sims, all_ids = np.concatenate([sims[live], found], axis=1), np.concatenate([ids[live], near], axis=1)
            all_done = np.concatenate([done[live], near < 0], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], done[live] = np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_done, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The nearest node found on the levels above ``to``, for each query."""
        at = np.full((len(q), 1), self.entry)
        for level in range(len(self.links) - 1, to, -1):
            at = self.search(q, at, level, 1)[0]
        return at

    def _diverse(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """m of each row's candidates (best first): one that is nearer to a chosen one than to the query waits until the others are in."""
        x = self.x[ids]
        between = np.einsum("qid,qjd->qij", x, x)
        kept = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            kept[:, j] = (ids[:, j] >= 0) & (kept.sum(axis=1) < m) & ~(kept[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
        rank = np.where(ids < 0, 2, np.where(kept, 0, 1))
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(ids, order, 1)

    def _insert(self, new: np.ndarray) -> None:
        start = None
        for level in range(len(self.links) - 1, -1, -1):
            q_ids = new[self.levels[new] >= level]
            if start is None:
                start = np.full((len(new), 1), self.entry)
            here = self.levels[new] >= level
            if level and (~here).any():
                start[~here, :1] = self.search(self.x[new[~here]], start[~here][:, :1], level, 1)[0]
            if not len(q_ids):
                continue
            q = self.x[q_ids]
            ids, sims = self.search(q, start[here], level, BUILD)
            if start.shape[1] < BUILD:
                start = np.pad(start, ((0, 0), (0, BUILD - start.shape[1])), constant_values=-1)
            start[here] = ids
            peers = q @ q.T
            np.fill_diagonal(peers, -np.inf)
            k = min(M0, len(q_ids) - 1)
            if k > 0:
                best = np.argpartition(-peers, k - 1, axis=1)[:, :k]
                ids, sims = np.concatenate([ids, q_ids[best]], axis=1), np.concatenate([sims, np.take_along_axis(peers, best, 1)], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            m = self.links[level].shape[1]
            chosen = self._diverse(q, ids, sims, m)
            self.links[level][q_ids, : chosen.shape[1]] = chosen
            self._back(level, np.repeat(q_ids, chosen.shape[1]), chosen.ravel())

    def _back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        """Add source to the links of target; full lists are chosen anew."""
        links, ok = self.links[level], target >= 0
        source, target = source[ok], target[ok]
        order = np.lexsort((-np.einsum("kd,kd->k", self.x[source], self.x[target]), target))
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(first, np.diff([*first, len(target)]))
        m = links.shape[1]
        more = np.full((len(nodes), 2 * m), -1, np.int64)
        ok = place < 2 * m
        more[np.searchsorted(nodes, target[ok]), place[ok]] = source[ok]
        ids = np.concatenate([links[nodes].astype(np.int64), more], axis=1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        for at in range(0, len(nodes), BLOCK):
            part = slice(at, at + BLOCK)
            sims = self._sims(ids[part], self.x[nodes[part]])
            order = np.argsort(-sims, axis=1, kind="stable")
            links[nodes[part]] = self._diverse(self.x[nodes[part]], np.take_along_axis(ids[part], order, 1), np.take_along_axis(sims, order, 1), m)

    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the lowest level, taken both ways: where each node's begin, and all of them."""
        if self._both is None:
            links, n = self.links[0], len(self.x)
            a, b = np.nonzero(links >= 0)
            c = links[a, b].astype(np.int64)
            key = np.unique(np.concatenate([a * n + c, c * n + a]))
            self._both = np.searchsorted(key, np.arange(n + 1) * n), key % n
        return self._both

    def within(self, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity ``least`` or more that a beam and its widening reach; ``own``: a node known to be near each query."""
        start = self.descend(q, 0)
        if own is not None:
            start = np.concatenate([start, own[:, None]], axis=1)
        ids, sims = self.search(q, start, 0, min(beam, max(len(self.x), 1)))
        a, b = np.nonzero(sims >= least)
        rows, nodes = a, ids[a, b]
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[rows, nodes] = True
        starts, ends = self.both_ways()
        degree, out = np.diff(starts), [(rows, nodes)]
        todo = [(rows[i : i + FRONTIER], nodes[i : i + FRONTIER]) for i in range(0, len(rows), FRONTIER)]
        while todo:
            rows, nodes = todo.pop()
            many = degree[nodes]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            near = ends[np.repeat(starts[nodes], many) + step]
            asks = np.repeat(rows, many)
            fresh = ~seen[asks, near]
            key = np.unique(asks[fresh] * len(self.x) + near[fresh])
            rows, nodes = key // len(self.x), key % len(self.x)
            seen[rows, nodes] = True
            ok = np.concatenate([np.einsum("kd,kd->k", self.x[nodes[i : i + FRONTIER]], q[rows[i : i + FRONTIER]]) for i in range(0, len(rows), FRONTIER)] or [np.empty(0)]) >= least
            rows, nodes = rows[ok], nodes[ok]
            out.append((rows, nodes))
            todo += [(rows[i : i + FRONTIER], nodes[i : i + FRONTIER]) for i in range(0, len(rows), FRONTIER)]
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def planted(unit: np.ndarray, at: np.ndarray, cosine: float, seed: int = 3) -> np.ndarray:
    """Unit vectors at ``cosine`` from the vectors ``at``, in random directions; the same vectors where there is no other direction."""
    x = unit[at]
    away = np.random.default_rng(seed).normal(size=x.shape)
    away -= np.einsum("kd,kd->k", away, x)[:, None] * x
    size = np.linalg.norm(away, axis=1)[:, None]
    return np.where(size > 1e-9, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.maximum(size, 1e-9), x)


def planted_beam(graph: Graph, unit: np.ndarray, threshold: float, beam: int = 0) -> int | None:
    """The least beam, of doubled ones, that finds the planted links; None if only all vectors are enough."""
    beam = beam or BEAM
    at = np.random.default_rng(4).permutation(len(unit))[:PLANTED]
    turned = planted(unit, at, min(1.0, threshold + SLACK)).astype(np.float32)
    while beam <= max(BEAM, WIDEST * len(unit)):
        rows, nodes = graph.within(turned, threshold - SLACK, beam)
        if (nodes == at[rows]).sum() >= RECALL * len(at):
            return beam
        beam *= 2
    return None


def enough(graph: Graph, unit: np.ndarray, queries: np.ndarray, own: np.ndarray | None, threshold: float, beam: int | None) -> int | None:
    """The least beam, from one that passed the planted audit on, that finds the links of a sample of queries too."""
    audit = np.random.default_rng(2).permutation(len(queries))[:AUDITED]
    true = queries[audit] @ unit.T >= threshold
    q32 = queries[audit].astype(np.float32)
    while beam is not None and beam <= max(BEAM, WIDEST * len(unit)):
        rows, nodes = graph.within(q32, threshold - SLACK, beam, own[audit] if own is not None else None)
        if true[rows, nodes].sum() >= RECALL * true.sum():
            return beam
        beam *= 2
    return None


def shard_links(unit: np.ndarray, queries: np.ndarray | None, threshold: float, graph: Graph | None = None, beam: int | None = 0):
    """Yields blocks of (query, node) links of at least ``threshold`` in double precision. ``queries`` None: the shard's own vectors, without a vector itself.

    ``graph``, ``beam``: the shard's graph and the beam that its planted links need (None: all vectors), where they were worked out before.
    """
    if graph is None:
        graph = Graph(unit)
        beam = planted_beam(graph, unit, threshold)
    q64 = unit if queries is None else queries
    q32 = q64.astype(np.float32)
    own = np.arange(len(unit)) if queries is None else None
    beam = enough(graph, unit, q64, own, threshold, beam)
    for at in range(0, len(q64), BLOCK):
        part = slice(at, at + BLOCK)
        if beam is None:
            rows, nodes = np.nonzero(q32[part] @ graph.x.T >= threshold - SLACK)
        else:
            rows, nodes = graph.within(q32[part], threshold - SLACK, beam, own[part] if own is not None else None)
        rows = rows + at
        ok = np.concatenate([np.einsum("kd,kd->k", q64[rows[i : i + FRONTIER]], unit[nodes[i : i + FRONTIER]]) for i in range(0, len(rows), FRONTIER)] or [np.empty(0)]) >= threshold
        if own is not None:
            ok &= rows != nodes
        yield rows[ok], nodes[ok]


def _roots(n: int, stars) -> np.ndarray:
    """Smallest connected position of each of n positions, over stars: labels spread until they settle."""
    label = np.arange(n)
    if stars:
        a, b = np.unique(np.concatenate(stars, axis=1), axis=1)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, before[a], low)
            np.minimum.at(label, before[b], low)
            label = label[label]
            if (label == before).all():
                return label
    return label


class Links:
    """Links among n vectors as a bit for each pair (34 MB for a full shard), so that a link that one end finds counts at both."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n, -(-n // 8)), np.uint8)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            np.bitwise_or.at(self.bits, (x, y >> 3), np.uint8(128) >> (y & 7).astype(np.uint8))

    def weights(self, size: np.ndarray, step: int = 512) -> np.ndarray:
        """The sum of the sizes of each vector's links."""
        return np.concatenate([np.unpackbits(self.bits[i : i + step], axis=1, count=self.n) @ size for i in range(0, self.n, step)] or [np.zeros(0, np.int64)])


def _unit(t: pa.Table) -> np.ndarray:
    x = matrix(t["vector"])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _build(threshold: float):
    """One shard: its distinct vectors, which row has which, and their graph with the beam that its planted links need, packed into one row."""

    def run(t: pa.Table) -> pa.Table:
        x = _unit(t)
        first, group, size = folded(x)
        graph = Graph(x[first])
        packed = pickle.dumps((x[first], group, size, t["rid"].to_numpy(), graph.links, graph.levels, graph.entry, planted_beam(graph, x[first], threshold)), 5)
        return pa.table({"label": t["label"].slice(0, 1), "dim": t["dim"].slice(0, 1), "own": t["own"].slice(0, 1), "packed": pa.array([packed], pa.binary())})

    return run


def _kernel(threshold: float):
    """A shard's graph and the vectors of that or another shard: each row's number of links there, and the row that its local component has the smallest id of."""
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(shards: pa.Table, asks: pa.Table) -> pa.Table:
        if not shards.num_rows:
            return schema.empty_table()
        unit, group, size, rid, links, levels, entry, beam = pickle.loads(shards["packed"][0].as_py())
        graph, stars, n = Graph.of(unit, links, levels, entry), [], len(unit)
        if asks.num_rows:
            x = _unit(asks)
            first, group2, size2 = folded(x)
            count, count2 = np.zeros(n, np.int64), np.zeros(len(first), np.int64)
            for q, c in shard_links(unit, x[first], threshold, graph, beam):
                np.add.at(count, c, size2[q])
                np.add.at(count2, q, size[c])
                stars.append(star(q + n, c))
            total, group, rid = np.concatenate([count, count2]), np.concatenate([group, group2 + n]), np.concatenate([rid, asks["rid"].to_numpy()])
            count = total[group]
        else:
            both = Links(n)
            for a, b in shard_links(unit, None, threshold, graph, beam):
                both.add(a, b)
                stars.append(star(a, b))
            total = both.weights(size)
            count = total[group] + size[group] - 1
        root = _roots(len(total), stars)
        least = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(least, root[group], rid)
        out = count > 0
        return pa.table([rid[out], count[out], least[root[group]][out]], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(id, n_links, component, kept) for each row.

    Vectors that are null, zero or hold a null or a non-finite component, and those without a label, link with nothing and are
    components of their own; so do vectors of different lengths among each other. Copies link with each other.
    Each row is a vector: repeated ids are rows of their own that may link. ``component`` is the smallest id reachable, null for a
    row without an id that reaches none; ``kept`` is false for such a row. An empty table gives an empty result.
    """
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "vectors")
    good = rows.filter(usable("vector") & F.col("label").isNotNull()).withColumn("dim", F.size("vector"))
    room = F.greatest(F.least(F.lit(shard), (F.lit(SHARD_BYTES) / (F.col("dim") * 8)).cast("int")), F.lit(1))
    sizes = materialize(good.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / room).cast("int").alias("shards")), "vector-shards")
    dealt = dealt_join(good, sizes, ["label", "dim"], "rid").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))
    kind = dict(rows.dtypes)["label"]
    graphs = materialize(dealt.select("label", "dim", "own", "rid", "vector").groupBy("label", "dim", "own").applyInArrow(_build(threshold), f"label {kind}, dim int, own int, packed binary"), "vector-graphs")
    # a shard's graph meets its own vectors and those of every later shard
    every = F.explode(F.sequence(F.col("own"), F.col("shards") - 1)).alias("high")
    searched = graphs.join(sizes, ["label", "dim"]).select("label", "dim", F.col("own").alias("low"), every, "packed")
    asks = dealt.filter("own > 0").select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("low"), F.col("own").alias("high"), "rid", "vector")
    keys = ["label", "dim", "low", "high"]
    met = searched.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(_kernel(threshold), "rid long, links long, root long")
    found = materialize(met, "vector-links")
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    comp = connected_components(found, "rid", "root").withColumnRenamed("node", "rid")
    named = rows.select("rid", "id").join(links, "rid", "left").join(comp, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialize(named, "vector-components")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    out = dealt_join(named, least, ["component"], "rid")
    result = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("least").alias("component"), F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("kept"))
    for t in (rows, graphs, found):
        drop_table(t)
    return result
