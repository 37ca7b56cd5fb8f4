"""Nearest neighbours without all pairs: neighbour descent.

A neighbour of a neighbour is likely a neighbour. Lists start from blocks of vectors that lie near each other along random directions. In each round a vector's
neighbours, and some of those that have it as one, are brought together; the distances of all pairs of them in which one is new are candidates for
both ends, and each vector keeps its best. Of a group's pairs only those leave the task that may enter a list: the k best of a member there, none beyond the last of its list so far. Rounds end when few lists change.

What meets is bounded: a vector is joined with at most ``meet`` of its list and as many of those that list it, chosen by a hash in each round, so one that a third of
all vectors list is no larger group. Pairs within a task are worked out for a batch of such groups at once. Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.graph import dealt_join
from meshloom.plans.storage import drop_table, materialize

#: Vectors of a starting block, directions that blocks are cut along, and neighbours of a vector (and vectors that it is one of) that meet in a round: so many, or k if that is more.
BLOCK, DIRECTIONS, MEET = 128, 3, 16


def _distances(v: np.ndarray) -> np.ndarray:
    """Cosine distances of all pairs in each group (groups, members, dims), rounded to 12 digits; that of a zero vector to all is 1."""
    u = v / np.maximum(np.linalg.norm(v, axis=2, keepdims=True), 1e-300)
    return np.round(1 - u @ u.transpose(0, 2, 1), 12)


def _start(vectors: DataFrame, k: int, direction: int, kind: str, block: int) -> DataFrame:
    """(id, other, distance): neighbours within blocks of vectors that follow each other along a random direction."""

    def along(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch["v"].to_numpy(zero_copy_only=False)).astype(float)
                d = np.random.default_rng(direction).normal(size=v.shape[1])
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(v @ d / np.maximum(np.linalg.norm(v, axis=1), 1e-300))], ["id", "v", "p"])

    def pairs(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 64 * block:
                yield from lists(held)
                held = []
        yield from lists(held)

    def lists(held):
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, v = t["id"].to_numpy(), np.stack(t["v"].to_numpy()).astype(float)
        for a in range(0, len(ids), block):
            own, d = ids[a : a + block], _distances(v[None, a : a + block])[0]
            if len(own) < 2:  # a last vector alone goes with those before it
                own, d = ids[-block:], _distances(v[None, -block:])[0]
            np.fill_diagonal(d, np.inf)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, best, axis=1).ravel()
            ok = np.isfinite(far)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best.shape[1])[ok]), pa.array(own[best.ravel()][ok]), pa.array(far[ok])], ["id", "other", "distance"])

    dealt = vectors.mapInArrow(along, f"id {kind}, v array<double>, p double")
    return dealt.repartitionByRange(F.col("p")).sortWithinPartitions("p", "id").mapInArrow(pairs, f"id {kind}, other {kind}, distance double")


def _kept(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each id, an other once (as old, if it was known)."""
    once = lists.filter("id <> other").groupBy("id", "other").agg(F.min("distance").alias("distance"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def descend(vectors: DataFrame, k: int = 30, key: str = "id", emb: str = "emb", max_rounds: int = 12, stop: float = 0.002, meet: int | None = None, block: int = BLOCK, directions: int = DIRECTIONS) -> DataFrame:
    """(id, rank, other, distance): about the k nearest of each row by cosine distance; ties to the smaller id. Distances are exact, a list may miss a few.

    ``vectors``: one row an id; null ids and null vectors take no part, all vectors have one length. It ends when fewer than ``stop`` of all entries change in a round. Lists are shorter than k only where
    there are no more vectors. An empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)[key]
    base = materialize(vectors.select(F.col(key).alias("id"), F.col(emb).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    total, meet = base.count(), meet or max(MEET, k)
    start = None
    for i in range(directions):
        one = _start(base, k, i, kind, max(block, k + 1)).withColumn("new", F.lit(1))
        start = one if start is None else start.unionByName(one)
    now = materialize(_kept(start, k), "lists")
    first = lambda by, name: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("new"), F.xxhash64("id", "other", F.lit(name))))
    schema = f"id {kind}, other {kind}, distance double, new int"
    for turn in range(max_rounds):
        # new ones come first, chosen by a hash; what has met is old in the next round
        out = now.withColumn("r", first("id", turn)).filter(F.col("r") <= meet)
        back = now.select(F.col("other").alias("id"), F.col("id").alias("other"), "new").withColumn("r", first("id", -1 - turn)).filter(F.col("r") <= meet)
        groups = materialize(out.select("id", "other", "new").union(back.select("id", "other", "new")).groupBy("id", "other").agg(F.max("new").alias("new")), "meetings")
        met = out.select("id", "other", F.lit(0).alias("__met"))
        # a list that isn't full takes any
        last = now.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("last"))
        known = base.join(last, "id", "left").select(F.col("id").alias("other"), "v", F.coalesce("last", F.lit(float("inf"))).alias("last"))
        # 2 x meet members at most
        gathered = dealt_join(groups, known, ["other"], "id").groupBy("id").agg(F.collect_list(F.struct("other", "new", "v", "last")).alias("m")).select("m")

        def pairs(batches):
            for batch in batches:
                yield from _candidates(batch["m"], k)

        found = gathered.mapInArrow(pairs, f"id {kind}, other {kind}, distance double").groupBy("id", "other").agg(F.min("distance").alias("distance"))
        old = now.join(met, ["id", "other"], "left").select("id", "other", "distance", F.coalesce("__met", "new").alias("new"))
        after = materialize(_kept(old.unionByName(found.withColumn("new", F.lit(1))).select(*[f.split()[0] for f in schema.split(", ")]), k), "lists")
        drop_table(groups)
        drop_table(now)
        now = after
        if now.filter("new = 1").count() <= stop * k * total:
            break
    return now.select("id", "rank", "other", "distance")


def _candidates(groups: pa.ListArray, k: int, step: int = 512):
    """(id, other, distance) of the pairs of members (other, new, v, last) of each group in which one is new; for each member, its k best of the group (and those that tie with the k-th), none farther than ``last``."""
    for a in range(0, len(groups), step):
        part = groups.slice(a, step)
        size, flat = np.diff(part.offsets.to_numpy()), part.flatten()
        if not len(flat):
            continue
        width = int(size.max())
        there = np.arange(width) < size[:, None]
        own = flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        v, new, last = np.zeros((*there.shape, own.shape[1])), np.zeros(there.shape, bool), np.zeros(there.shape)
        v[there], new[there], last[there] = own, flat.field("new").to_numpy() > 0, flat.field("last").to_numpy()
        at = np.zeros(there.shape, np.int64)
        at[there] = np.arange(len(flat))
        d = _distances(v)
        # a group has a member once
        ok = there[:, :, None] & there[:, None] & (new[:, :, None] | new[:, None]) & ~np.eye(width, dtype=bool) & (d <= last[:, :, None])
        if width > k:
            far = np.where(ok, d, np.inf)
            ok &= far <= np.partition(far, k - 1, axis=2)[:, :, k - 1 : k]
        g, i, j = np.nonzero(ok)
        ids = flat.field("other")
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[g, i])), ids.take(pa.array(at[g, j])), pa.array(d[ok])], ["id", "other", "distance"])


def recall(found: DataFrame, exact: DataFrame, k: int) -> float:
    """Share of the exact lists' entries that lists as long as these hold, by distance: an entry as near as the exact k-th counts, so ties don't matter."""
    last = exact.groupBy("id").agg(F.max("distance").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "id").filter(F.col("distance") <= F.col("last")).groupBy("id", "n").agg(F.count("*").alias("h"))
    row = last.join(hits.select("id", "h"), "id", "left").agg(F.sum(F.least(F.coalesce("h", F.lit(0)), "n")), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0
