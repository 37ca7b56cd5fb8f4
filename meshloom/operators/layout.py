"""A two-dimensional layout of a fuzzy neighbour graph, by UMAP's rules.

The layout's similarity is 1 / (1 + a d^(2b)), fitted to one that is 1 up to ``min_dist`` and falls off by ``spread`` beyond. Nodes start at the slow
directions of the graph's random walk, found by power rounds with sums alone. Then each edge is due in every (greatest weight / weight)-th epoch; an end of a due
edge moves towards the other and away from random nodes, by the gradients of the similarity, with steps that shrink to zero.

Nodes are dealt to blocks by a hash, and the edges of a hub to several pieces of its block, so a task holds ``BLOCK`` nodes and the edges that lead from them. Edges are packed once, a row a piece; what moves
in a round is where nodes are, once to each piece that one has an edge in. A round is some epochs in each block: nodes of the block move at once, those of other blocks stay where they were at the round's start; a bounded sample of all nodes is what is moved away from. A hub
takes the mean of its pieces' moves. Rounds are written to the shared folder, a row a node.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.graph import dealt_join
from meshloom.plans.storage import drop_table, materialize

#: Nodes of a block, edges of a node in one piece of it, nodes that a round's moves lead away from.
BLOCK, PIECE, AWAY = 20_000, 10_000, 2_000


def curve(spread: float = 1.0, min_dist: float = 0.3) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^(2b)), by least squares against 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond, on 300 distances up to 3 spreads."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damp = np.zeros(2), 1e-2  # logarithms of a and b
    value = lambda p: 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1])))
    for _ in range(200):
        y = value(p)
        slope = -(y**2) * np.exp(p[0]) * d ** (2 * np.exp(p[1]))
        jac = np.stack([slope, slope * 2 * np.exp(p[1]) * np.log(d)], axis=1)
        h = jac.T @ jac
        step = np.linalg.solve(h + damp * np.diag(np.diag(h)), jac.T @ (want - y))
        better = ((value(p + step) - want) ** 2).sum() < ((y - want) ** 2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 5)
        if better and np.abs(step).max() < 1e-10:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def packed(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (block, piece, node, other, w) as a row for each piece (block, piece, head, tail, w), in order of node and other, and (node, homes): the pieces that each node has an edge in, as one end or the other.

    head, tail: numbers of the ends among the piece's nodes, sorted.
    """

    def pack(t: pa.Table) -> pa.Table:
        df = t.select(["node", "other", "w"]).to_pandas().sort_values(["node", "other"], ignore_index=True)
        node, other = df["node"].to_numpy(), df["other"].to_numpy()
        ids = np.unique(np.concatenate([node, other]))
        row = [np.searchsorted(ids, node).astype("<i4").tobytes(), np.searchsorted(ids, other).astype("<i4").tobytes(), df["w"].to_numpy().astype("<f8").tobytes()]
        return pa.table({"block": t["block"][:1], "piece": t["piece"][:1], **{c: pa.array([x], pa.binary()) for c, x in zip(("head", "tail", "w"), row, strict=True)}})

    rows = materialize(dealt.groupBy("block", "piece").applyInArrow(pack, "block long, piece long, head binary, tail binary, w binary"), "layout-packed")
    ends = dealt.select("node", "block", "piece").union(dealt.select("other", "block", "piece")).distinct()
    # a piece of each block at most, or those of its own
    return rows, materialize(ends.groupBy("node").agg(F.collect_list(F.struct("block", "piece")).alias("homes")), "layout-homes")


def in_pieces(now: DataFrame, rows: DataFrame, homes: DataFrame, blocks: int, work: Callable[..., dict], kind: str, schema: str) -> DataFrame:
    """(node, ...) of ``work(at, head, tail, w, key)`` of each piece of ``packed``, with the places ``at`` of its nodes by their numbers from ``now`` (node, at). ``work`` gives the numbers of
    the piece's own nodes (``own``) and a list of arrays, one for each further column."""
    names = [c.split()[0] for c in schema.split(", ")]
    spread = 4 * blocks  # a number, as small partitions are put together otherwise and pieces wait for each other
    sent = now.select("node", "at").join(homes, "node").select("node", "at", F.explode("homes").alias("home")).select("home.*", "node", "at")

    def kernel(key, here: pa.Table, t: pa.Table) -> pa.Table:
        ids, at = here["node"].to_numpy(), here["at"].combine_chunks().flatten().to_numpy()
        order = np.argsort(ids)
        head, tail, w = (np.frombuffer(t[c][0].as_py(), kind) for c, kind in (("head", "<i4"), ("tail", "<i4"), ("w", "<f8")))
        own, *columns = work(at.reshape(len(ids), -1)[order], head, tail, w, (key[0].as_py(), key[1].as_py()))
        return pa.table({"node": here["node"].combine_chunks().take(pa.array(order[own])), **{n: pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.float64())) for n, c in zip(names, columns, strict=True)}})

    sent, rows = (df.repartition(spread, "block", "piece") for df in (sent, rows))
    return sent.groupBy("block", "piece").cogroup(rows.groupBy("block", "piece")).applyInArrow(kernel, f"node {kind}, {schema}")


def pulled(at: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, key=None):
    """Of a piece's own nodes: numbers, places, and the sums of their neighbours' places by weight, with the weights' sum."""
    own, first = np.unique(head, return_index=True)  # edges are in order of their node
    sums = np.add.reduceat(np.column_stack([at[tail] * w[:, None], w]), first, axis=0)
    return own, at[own], sums


def slow_directions(nodes: DataFrame, pull: Callable[[DataFrame], DataFrame], dims: int, rounds: int, seed: int) -> DataFrame:
    """(node, at): the ``dims`` slowest directions after the constant one, scaled to 10, with a little noise by the node's hash so that no two nodes coincide.

    ``nodes`` (node, k); ``pull`` gives ``pulled`` of every piece of a table (node, at). A round averages each node with its neighbours, and takes the constant and earlier directions out by sums.
    """
    noise = lambda i: F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1
    now = nodes.select("node", "k", F.array(*[noise(i) for i in range(dims)]).alias("at"))
    at = lambda i: F.col("at")[i]
    for turn in range(rounds):
        if turn:
            sums = pull(now).groupBy("node").agg(F.first("at").alias("at"), *[F.sum(F.col("sums")[i]).alias(f"m{i}") for i in range(dims + 1)])
            k = F.col(f"m{dims}")
            now = sums.select("node", k.alias("k"), F.array(*[(at(i) + F.col(f"m{i}") / k) / 2 for i in range(dims)]).alias("at"))
        now = materialize(now, "directions")
        # Gram matrix, weighted by k, of the constant and the columns; the columns are made orthonormal by it
        cols = [F.lit(1.0), *[at(i) for i in range(dims)]]
        sums = now.agg(*[F.sum(F.col("k") * cols[i] * cols[j]) for i in range(dims + 1) for j in range(i + 1)]).first()
        gram = np.zeros((dims + 1, dims + 1))
        for s, (i, j) in zip(sums, [(i, j) for i in range(dims + 1) for j in range(i + 1)], strict=True):
            gram[i, j] = gram[j, i] = s
        basis = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(dims + 1)))
        now = now.select("node", "k", F.array(*[sum((F.lit(float(basis[i + 1, j])) * cols[j] for j in range(dims + 1)), F.lit(0.0)) for i in range(dims)]).alias("at"))
    most = now.agg(F.max(F.greatest(*[F.abs(at(i)) for i in range(dims)]) if dims > 1 else F.abs(at(0)))).first()[0] or 1.0
    return now.select("node", F.array(*[10 * at(i) / most + 0.01 * noise(i + dims) for i in range(dims)]).alias("at"))


def epochs_of(rows: pd.DataFrame, away: np.ndarray, count: int, a: float, b: float, first: int, last: int, epochs: int, top: float, negatives: int, rate: float, seed: tuple[int, int], key: tuple[int, int] = (0, 0)) -> pd.DataFrame:
    """(node, at) after epochs ``first`` to ``last`` of a block's rows (node, at, other, there, w)."""
    ids, head = np.unique(rows["node"].to_numpy(), return_inverse=True)
    p = np.zeros((len(ids), len(rows["at"].iloc[0])))
    p[head] = np.stack(rows["at"].to_numpy())
    other = rows["other"].to_numpy()
    tail = np.searchsorted(ids, other).clip(max=len(ids) - 1)
    after = _epochs(p, head, tail, ids[tail] == other, np.stack(rows["there"].to_numpy()), rows["w"].to_numpy(), away, count, a, b, first, last, epochs, top, negatives, rate, seed, key)
    return pd.DataFrame({"node": ids, "at": list(after)})


def stepped(at: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, key: tuple[int, int], **given):
    """Of a piece's own nodes: numbers, and places after a round's epochs."""
    own, head = np.unique(head, return_inverse=True)
    number = np.full(len(at), -1)
    number[own] = np.arange(len(own))
    return own, _epochs(at[own], head, number[tail], number[tail] >= 0, at[tail], w, key=key, **given)


def _epochs(p, head, tail, inside, there, w, away, count, a, b, first, last, epochs, top, negatives, rate, seed, key) -> np.ndarray:
    """Places ``p`` of a block's nodes after epochs ``first`` to ``last`` of its edges: from ``head`` to ``tail`` where that is ``inside``, else to one that stays ``there``."""
    every = top / w  # epochs between an edge's turns
    r = np.random.default_rng([*seed, *key])
    for e in range(first, last):
        turn = r.permutation(np.flatnonzero(np.floor((e + 1) / every) > np.floor(e / every)))
        step = rate * (1 - e / epochs)
        # few edges for each node at once, so that moves see those before them
        for due in np.array_split(turn, max(1, 4 * len(turn) // len(p))):
            i = head[due]
            gap = p[i] - np.where(inside[due, None], p[tail[due]], there[due])
            q = np.maximum((gap * gap).sum(axis=1, keepdims=True), 1e-12)
            # an edge is listed from both ends, and each listing moves its own end
            move = np.clip(-2 * a * b * q ** (b - 1) / (1 + a * q**b) * gap, -4, 4)
            # random nodes: those of the block are where they are now, others where the round's sample has them
            here = r.random((len(i), negatives, 1)) < len(p) / count
            gap = p[i][:, None] - np.where(here, p[r.integers(0, len(p), (len(i), negatives))], away[r.integers(0, len(away), (len(i), negatives))])
            q = (gap * gap).sum(axis=2, keepdims=True)
            move += np.clip(2 * b / ((0.001 + q) * (1 + a * np.maximum(q, 1e-12) ** b)) * gap, -4, 4).sum(axis=1)
            np.add.at(p, i, step * move)
    return p


def umap(graph: DataFrame, dims: int = 2, spread: float = 1.0, min_dist: float = 0.3, epochs: int = 200, rounds: int = 10, negatives: int = 5, rate: float = 1.0, start_rounds: int = 10, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(id, at): the layout of a fuzzy graph (id, other, weight; both directions); see the module.

    Loops, null ends and weights that aren't above zero are ignored, and so are nodes without other edges; repeated edges add up. An empty graph gives an empty result. Equal inputs give
    equal layouts on one plan of partitions; others differ by rounding.
    """
    kind = dict(graph.dtypes)["id"]
    clean = graph.select(F.col("id").alias("node"), "other", F.col("weight").cast("double").alias("w")).filter("node IS NOT NULL AND other IS NOT NULL AND node <> other AND w > 0")
    edges = materialize(clean.groupBy("node", "other").agg(F.sum("w").alias("w")), "layout-edges")
    nodes = materialize(edges.groupBy("node").agg(F.sum("w").alias("k"), F.count("*").alias("n")), "layout-nodes")
    count, top = nodes.count(), edges.agg(F.max("w")).first()[0]
    if not count:
        return edges.select(F.col("node").alias("id"), F.array().cast("array<double>").alias("at"))
    pieces, blocks = F.ceil(F.col("n") / PIECE), -(-count // block)
    dealt = dealt_join(edges, nodes.select("node", "n"), ["node"], "other").select(
        F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("other"), pieces).alias("piece"), "node", "other", "w",
    )
    rows, homes = packed(dealt_join(dealt, nodes.select(F.col("node").alias("other")), ["other"], "node"))  # ends that lead nowhere have no place
    drop_table(edges)
    moved = lambda now, work, schema: in_pieces(now, rows, homes, blocks, work, kind, schema)
    now = materialize(slow_directions(nodes, lambda now: moved(now, pulled, "at array<double>, sums array<double>"), dims, start_rounds, seed), "layout")
    a, b = curve(spread, min_dist)
    for turn in range(rounds):
        first, last = turn * epochs // rounds, (turn + 1) * epochs // rounds
        away = np.array([r["at"] for r in now.orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(AWAY).collect()])  # AWAY rows
        step = partial(stepped, away=away, count=count, a=a, b=b, first=first, last=last, epochs=epochs, top=top, negatives=negatives, rate=rate, seed=(seed, turn))
        after = materialize(moved(now, step, "at array<double>").groupBy("node").agg(F.array(*[F.avg(F.col("at")[i]) for i in range(dims)]).alias("at")), "layout")
        drop_table(now)
        now = after
    for t in (rows, homes):
        drop_table(t)
    return now.select(F.col("node").alias("id"), "at")
