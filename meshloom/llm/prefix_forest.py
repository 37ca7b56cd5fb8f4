"""Approximate nearest neighbours by a forest of hash prefixes.

Vectors are dealt into shards. A tree of a shard is a sorted array of long hash strings: each bit says on which side of a
random hyperplane, set at a random vector's projection, a vector lies. A query descends every tree to the
longest prefix that it shares with any vector, and then all trees ascend together, a bit at a time, until enough candidates are
under their prefixes. How many are enough is found in each shard by an audit: a sample of queries is compared with all vectors, and the
number doubles until the recall is reached. Candidates are ranked by their exact distance; shards' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.vectors import matrix, usable
from meshloom.plans.storage import materialize

SHARD, QUERY_BLOCK = 8192, 8192
TREES, BITS, NEAREST = 12, 64, 10
AUDITED, RECALL, FIRST = 48, 0.95, 512


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 3):
        r = np.random.default_rng(seed)
        self.x = x
        self.planes = r.normal(size=(trees, x.shape[1], BITS))
        self.offsets = np.stack([np.take_along_axis(x @ p, r.integers(0, len(x), (1, BITS)), 0)[0] for p in self.planes])
        keys = [self._keys(x, t) for t in range(trees)]
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.sorted = [k[o] for k, o in zip(keys, self.order, strict=True)]

    def _keys(self, x: np.ndarray, tree: int) -> np.ndarray:
        bits = x @ self.planes[tree] >= self.offsets[tree]
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of the vectors that share each prefix length (0 to BITS) with each query, in each tree."""
        masks = np.array([((1 << BITS) - 1) ^ ((1 << (BITS - d)) - 1) for d in range(BITS + 1)], np.uint64)
        lo, hi = [], []
        for t in range(len(self.sorted)):
            k = self._keys(q, t)[:, None]
            lo.append(np.searchsorted(self.sorted[t], k & masks))
            hi.append(np.searchsorted(self.sorted[t], k | ~masks, side="right"))
        return np.stack(lo, axis=2), np.stack(hi, axis=2)

    def candidates(self, q: np.ndarray, enough: int) -> list[np.ndarray]:
        """Vectors under the longest prefixes, of one length for all trees, that hold ``enough`` in all."""
        lo, hi = self.ranges(q)
        depth = ((hi - lo).sum(axis=2) >= min(enough, len(self.x) * len(self.order))).sum(axis=1) - 1  # shorter prefixes hold no fewer
        return [np.unique(np.concatenate([self.order[t][lo[i, d, t] : hi[i, d, t]] for t in range(len(self.order))])) for i, d in enumerate(depth)]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def enough_candidates(forest: Forest, q: np.ndarray, own: np.ndarray, ids: np.ndarray, nearest: int) -> int:
    """How many candidates give the recall on a sample of queries."""
    audit = np.random.default_rng(4).permutation(len(q))[:AUDITED]
    true = []
    for i in audit:
        d = distances(forest.x, q[i])
        d[ids == own[i]] = np.inf
        true.append(np.sort(d)[: min(nearest, int(np.isfinite(d).sum()))])
    enough = FIRST
    while enough < len(forest.x) * len(forest.order):
        hits = total = 0
        for i, want, c in zip(audit, true, forest.candidates(q[audit], enough), strict=True):
            got = distances(forest.x[c], q[i])[ids[c] != own[i]]
            if len(want):
                hits, total = hits + min(int((got <= want[-1]).sum()), len(want)), total + len(want)
        if hits >= RECALL * total:
            break
        enough = enough * 3 // 2
    return enough


def _kernel(nearest: int):
    schema = pa.schema([("qid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, ids = matrix(data["vector"]), data["id"].to_numpy()
        q, own, qid = matrix(queries["vector"]), queries["id"].to_numpy(), queries["qid"].to_numpy()
        forest = Forest(x)
        enough = enough_candidates(forest, q, own, ids, nearest)
        out = []
        for at in range(0, len(q), 256):
            for i, c in enumerate(forest.candidates(q[at : at + 256], enough), at):
                c = c[ids[c] != own[i]]
                d = distances(x[c], q[i])
                if len(c) > nearest:
                    near = d <= np.partition(d, nearest - 1)[nearest - 1]
                    c, d = c[near], d[near]
                best = np.lexsort((ids[c], d))[:nearest]
                out.append((np.full(len(best), qid[i]), np.full(len(best), own[i]), ids[c[best]], d[best]))
        return pa.table([np.concatenate(col) for col in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """(query_id, rank int, vec_id, score double): the ``nearest`` found for each row where ``is_query`` holds, by Euclidean distance.

    Vectors that are null, zero or hold a null or a non-finite component take no part, nor do rows without an id; vectors of another
    length than the query's aren't compared. A row of the query's own id is no candidate. Ties go to the smaller id. Each query row has its
    own list, so repeated query rows give repeated lists. Fewer candidates give shorter lists; an empty table gives none.
    """
    good = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = materialize(good.filter("asks").select(F.monotonically_increasing_id().alias("qid"), "id", "vector", "dim"), "queries")
    shards, blocks = max(1, -(-good.count() // shard)), max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = good.select("dim", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "id", "vector")
    queries = asked.select("dim", every(shards).alias("shard"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), "qid", "id", "vector")
    keys = ["dim", "shard", "block"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_kernel(nearest), "qid long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

