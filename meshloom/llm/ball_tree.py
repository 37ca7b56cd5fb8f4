"""Centroid clustering of integer vectors, filtered through ball trees.

Vectors become whole numbers, so that sums, means and distances are exact and don't depend on the order of rows. Each task cuts its rows into blocks
and grows a metric tree over each; a ball holds its radius, count and integer sum. The trees are written to the shared folder once. In each round the
centroids (k rows) go to every task with the closure. By the triangle inequality a centroid farther from a ball's centre than the nearest one by more than
twice the radius owns none of its points; a ball left with one centroid gives its count and sum as a whole, any other is opened, down to leaves,
whose points are compared exactly. A task returns k rows of counts and sums at most, which a grouped aggregate adds up.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; scaled components beyond 2^27 count as
2^27 (see ``integers.BOUND``); a null id is hashed as an empty one; equal ids are told apart by their vectors; repeated rows are rows each. With fewer
vectors than centroids each is one. An empty table gives an empty result. Sums beyond a long are given as the greatest long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.integers import add_rows, digest, finite, floors, nearest
from meshloom.llm.vectors import matrix
from meshloom.plans.storage import drop_table, materialize

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a tree, and points that a ball isn't split below.
BLOCK, LEAF = 8192, 24
#: Relative slack of distances in doubles, far above their rounding: a ball is only given away where no exact comparison could differ.
SLACK = 1e-9


@dataclass
class Balls:
    """A tree in arrays: points in the order of leaves, and for each ball the range of its points, its children (-1: a leaf), radius and integer sum."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.last - self.first


def grow(x: np.ndarray, leaf: int = LEAF) -> tuple[Balls, np.ndarray]:
    """A tree over the rows of ``x``, and the order in which it holds them. A ball is cut between two points that lie far apart; a lopsided cut is
    replaced by one at the median, so depth is logarithmic. Balls of equal points aren't cut."""
    order, rows = np.arange(len(x)), []
    children: list[list[int]] = []
    stack = [(0, len(x), -1, 0)]
    while stack:
        a, b, up, side = stack.pop()
        me = len(rows)
        if up >= 0:
            children[up][side] = me
        own = x[order[a:b]]
        total = own.sum(axis=0)
        away = own - total / (b - a)
        d = np.sqrt(np.einsum("ij,ij->i", away, away))
        rows.append((a, b, d.max(), total))
        children.append([-1, -1])
        if b - a > leaf and d.max() > 0:
            one = away[d.argmax()]
            gap = away - one
            other = away[np.einsum("ij,ij->i", gap, gap).argmax()]
            along = away @ (other - one)
            right = along > (one + other) @ (other - one) / 2
            m = int((~right).sum())
            if min(m, b - a - m) * 16 < b - a:
                right, m = np.zeros(b - a, bool), (b - a) // 2
                right[np.argsort(along, kind="stable")[m:]] = True
            order[a:b] = np.concatenate([order[a:b][~right], order[a:b][right]])
            stack += [(a, a + m, me, 0), (a + m, b, me, 1)]
    links = np.array(children, np.int64).reshape(-1, 2)
    return Balls(x[order], *(np.array([r[i] for r in rows], np.int64) for i in (0, 1)), links[:, 0], links[:, 1], np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64)), order


def settle(t: Balls, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Balls that go to one centroid as a whole, those centroids, and the positions of all points that no such ball holds."""
    front, balls, owners, open_ = np.zeros(1, np.int64), [], [], []
    while len(front):
        centre = t.total[front] / t.count[front][:, None]
        d = np.stack([np.sqrt(np.square(centre - one).sum(axis=1)) for one in c.astype(np.float64)], axis=1)
        least, r = d.min(axis=1, keepdims=True), t.radius[front][:, None]
        possible = d <= least + 2 * r + SLACK * (d + least + r + 1)
        sure = possible.sum(axis=1) == 1
        balls.append(front[sure])
        owners.append(d[sure].argmin(axis=1))
        rest = front[~sure]
        end = t.left[rest] < 0
        open_ += [np.arange(t.first[i], t.last[i]) for i in rest[end]]
        front = np.concatenate([t.left[rest[~end]], t.right[rest[~end]]])
    return np.concatenate(balls), np.concatenate(owners), np.concatenate(open_) if open_ else np.zeros(0, np.int64)


def assign(t: Balls, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's centroid and squared distance, in the tree's order."""
    which, far = np.empty(len(t.points), np.int64), np.empty(len(t.points), np.int64)
    balls, owners, rows = settle(t, c)
    for i, k in zip(balls, owners, strict=True):
        at = slice(t.first[i], t.last[i])
        which[at], gap = k, t.points[at] - c[k]
        far[at] = np.einsum("ij,ij->i", gap, gap)
    which[rows], far[rows] = nearest(t.points[rows], c)
    return which, far


def sums(t: Balls, c: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Add the tree's points to the sums and counts of their centroids; whole balls by their own sum and count."""
    balls, owners, rows = settle(t, c)
    np.add.at(total, owners, t.total[balls])
    np.add.at(count, owners, t.count[balls])
    add_rows(total, count, nearest(t.points[rows], c)[0], t.points[rows])


def in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``size`` rows; the last may be smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            take = min(size - n, batch.num_rows)
            held.append(batch.slice(0, take))
            batch, n = batch.slice(take), n + take
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def trees(rows: DataFrame, scale: int, block: int = BLOCK) -> DataFrame:
    """(ids, points, first, last, left, right, radius, total): a tree a row, over the ``rows`` (id, v) of a task."""
    schema = f"ids array<{dict(rows.dtypes)['id']}>, dims int, points binary, first binary, last binary, left binary, right binary, radius binary, total binary"

    def run(batches):
        for t in in_blocks(batches, block):
            tree, order = grow(floors(matrix(t["v"]), scale))
            ids = t["id"].combine_chunks().take(pa.array(order))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            parts = (tree.points.astype(np.int32), tree.first, tree.last, tree.left, tree.right, tree.radius, tree.total)
            yield pa.RecordBatch.from_arrays([ids, pa.array([tree.points.shape[1]], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names)

    names = ["ids", "dims", "points", "first", "last", "left", "right", "radius", "total"]
    return rows.mapInArrow(run, schema)


def read(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Balls]]:
    """Ids and tree of each row."""
    for i in range(batch.num_rows):
        dims, raw = batch["dims"][i].as_py(), lambda name, kind: np.frombuffer(batch[name][i].as_buffer(), kind)  # noqa: B023
        links = [raw(n, np.int64) for n in ("first", "last", "left", "right")]
        yield batch["ids"][i].values, Balls(raw("points", np.int32).reshape(-1, dims).astype(np.int64), *links, raw("radius", np.float64), raw("total", np.int64).reshape(-1, dims))


def move(forest: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids of the next round: exact floors of the means of their vectors; those without vectors stay."""
    k, dims = c.shape

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, tree in read(batch):
                sums(tree, c, total, count)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    added = forest.mapInArrow(run, "cluster int, n long, total array<long>").groupBy("cluster")
    out = c.copy()
    for row in added.agg(F.sum("n"), *[F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(dims)]).collect():  # k rows at most
        out[row[0]] = [int(s) // row[1] for s in row[2:]]
    return out


def cluster(vectors: DataFrame, dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part; see the module.

    The first centroids are the vectors whose sha256 of "<seed>:<id>" is smallest, in that order.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter((F.size("v") == dims) & finite("v"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.orderBy(named, "v").limit(centroids).collect()  # the centroids alone
    c = floors(np.array([r["v"] for r in start], np.float64).reshape(-1, dims), scale)
    forest = materialize(trees(rows, scale, block), "balls")
    for _ in range(rounds):
        c = move(forest, c)

    def run(batches):
        for batch in batches:
            for ids, tree in read(batch):
                which, far = assign(tree, c)
                yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    placed = materialize(forest.mapInArrow(run, f"id {kind}, cluster int, distance long"), "placed")
    drop_table(forest)
    found = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a centroid
    most, every = (1 << 63) - 1, sum(found.values())
    side = spark.createDataFrame([(k, min(v, most), min(every, most), digest(c[k])) for k, v in sorted(found.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(side), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
