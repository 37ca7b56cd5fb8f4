"""Batch integration: embeddings of cells from several batches moved onto each other, cluster by cluster.

Cells are assigned softly to clusters by their cosine to the clusters' centres. A penalty lowers a cluster's pull on cells of a batch that it holds more of than
the batch's share, so clusters mix batches. Then each cluster fits, by ridge regression on the cells' weights, how far its cells lie from the cluster's common
level because of their batch; each cell is moved back by these, weighted by its memberships. This goes on for a few rounds.

All that leaves the cells are sums by (combination of batches, cluster): weights and weighted vectors. They give the centres, the shares and the normal equations
exactly, so no step sees more than clusters x combinations rows, and one job is a pass over the cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.plans.storage import drop_table, materialize

#: Combinations of batch variables at most: their sums meet on the driver.
COMBINATIONS = 1000


@dataclass
class Clusters:
    """What decides memberships: unit centres (k x dims), and for each variable the log penalties (k x levels)."""

    centres: np.ndarray
    sigma: float
    penalties: list[np.ndarray] = field(default_factory=list)

    def memberships(self, z: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """(cells, k): positive, each row sums to one. ``levels``: the level of each variable (cells x variables)."""
        pull = -2 * (1 - unit(z) @ self.centres.T) / self.sigma
        for v, p in enumerate(self.penalties):
            pull = pull + p[:, levels[:, v]].T
        pull = np.exp(pull - pull.max(axis=1, keepdims=True))
        return pull / pull.sum(axis=1, keepdims=True)


def unit(z: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    return z / np.maximum(np.sqrt((z * z).sum(axis=-1, keepdims=True)), 1e-300)


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch[n].flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for n in names]


def sums(cells: DataFrame, clusters: Clusters, combos: np.ndarray, dims: int, of: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of memberships (combinations x k) and of membership times vector (combinations x k x dims), of unit vectors ("unit") or those given ("z")."""
    k = len(clusters.centres)

    def run(batches):
        n, s, seen = np.zeros((len(combos), k)), np.zeros((len(combos), k, dims)), np.zeros(len(combos), bool)
        for batch in batches:
            if batch.num_rows:
                z, now = columns(batch, "z", "now")
                which = batch["combo"].to_numpy()
                r = clusters.memberships(now, combos[which])
                own = z if of == "z" else unit(now)
                for c in np.unique(which):
                    at = which == c
                    seen[c] = True
                    n[c] += r[at].sum(axis=0)
                    s[c] += r[at].T @ own[at]
        at = np.argwhere(seen[:, None] & np.ones(k, bool))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[at[:, 0], at[:, 1]]), pa.array(s[at[:, 0], at[:, 1]].tolist(), pa.list_(pa.float64()))], ["combo", "k", "n", "s"])

    parts = cells.mapInArrow(run, "combo int, k int, n double, s array<double>")
    n, s = np.zeros((len(combos), k)), np.zeros((len(combos), k, dims))
    for row in parts.groupBy("combo", "k").agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(dims)]).collect():  # combinations x clusters rows
        n[row[0], row[1]], s[row[0], row[1]] = row[2], row[3:]
    return n, s


def by_level(n: np.ndarray, combos: np.ndarray, v: int) -> np.ndarray:
    """Sums (combinations x k) as (k x levels) of variable ``v``."""
    out = np.zeros((n.shape[1], combos[:, v].max() + 1))
    np.add.at(out.T, combos[:, v], n)
    return out


def ridge(n: np.ndarray, s: np.ndarray, combos: np.ndarray, lam: float) -> list[np.ndarray]:
    """For each variable, what each level adds to the vectors of each cluster (k x levels x dims): weighted least squares on an intercept and all levels, the
    levels' terms (not the intercept) held down by ``lam``."""
    sizes = combos.max(axis=0) + 1
    design = np.zeros((len(combos), 1 + sizes.sum()))
    design[:, 0] = 1
    starts = 1 + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for v, start in enumerate(starts):
        design[np.arange(len(combos)), start + combos[:, v]] = 1
    held = lam * np.diag(np.r_[0.0, np.ones(sizes.sum())])
    w = np.zeros((n.shape[1], design.shape[1], s.shape[2]))
    for k in range(n.shape[1]):
        if n[:, k].sum() > 0:
            w[k] = np.linalg.lstsq((design * n[:, k, None]).T @ design + held, design.T @ s[:, k], rcond=None)[0]
    return [w[:, a : a + m] for a, m in zip(starts, sizes, strict=True)]


def integrate(cells: DataFrame, variables: list[str], dims: int, clusters: int = 20, theta: float = 2.0, lam: float = 1.0, sigma: float = 0.1, rounds: int = 10, inner: int = 4, early_stop: bool = True, tolerance: float = 1e-3, key: str = "cell_id", emb: str = "emb") -> DataFrame:
    """``cells`` with ``emb`` replaced by integrated embeddings; all columns and rows are kept.

    ``variables`` name the batches (several are corrected at once; null is a batch of its own), at most ``COMBINATIONS`` combinations. The first centres are the
    unit vectors of the ``clusters`` cells whose sha256 of the id is smallest. ``inner`` rounds of centres and penalties come before each of at most ``rounds``
    corrections; with ``early_stop`` these end once no correction changes by more than ``tolerance`` of the largest. ``theta`` weighs the penalty, ``lam`` is the ridge, ``sigma`` the
    softness. Cells with a null embedding keep it and have no say; without cells or with one batch nothing moves.
    """
    spark = cells.sparkSession
    found = cells.select(*variables).distinct().limit(COMBINATIONS + 1).collect()
    if len(found) > COMBINATIONS:
        raise ValueError(f"more than {COMBINATIONS} combinations of {variables}")
    values = [sorted({r[v] for r in found}, key=lambda x: (x is None, x)) for v in range(len(variables))]
    combos = np.array([[values[v].index(x) for v, x in enumerate(r)] for r in found], int).reshape(-1, len(variables))
    kinds = dict(cells.dtypes)
    # columns by place, so that none clashes with those added here
    at = {c: f"c{i}" for i, c in enumerate(cells.columns)}
    named = cells.toDF(*at.values())
    levels = [f"level{v}" for v in range(len(variables))]
    side = spark.createDataFrame([(*r, i) for i, r in enumerate(found)], ", ".join([*[f"{n} {kinds[v]}" for n, v in zip(levels, variables, strict=True)], "combo int"]))
    match = F.lit(True)
    for n, v in zip(levels, variables, strict=True):
        match = match & F.col(at[v]).eqNullSafe(F.col(n))
    # the side has COMBINATIONS rows at most
    rows = named.join(F.broadcast(side), match).drop(*levels).withColumn("z", F.col(at[emb]).cast("array<double>"))
    whole = rows.filter("z IS NOT NULL").withColumn("id", F.col(at[key]))
    start = whole.orderBy(F.sha2(F.col("id").cast("string"), 256), "id", "combo").limit(clusters).collect()  # the centres alone
    if not start or len(found) < 2:
        return cells
    now = materialize(rows.withColumn("now", F.col("z")), "integration")
    whole = now.filter("z IS NOT NULL").select("z", "now", "combo")
    state, last = Clusters(unit(np.array([r["z"] for r in start], float)), sigma), None
    share = np.zeros(len(combos))
    for row in whole.groupBy("combo").count().collect():
        share[row[0]] = row[1]
    share = [np.bincount(combos[:, v], share) / share.sum() for v in range(len(variables))]
    held: list[np.ndarray] = []
    for turn in range(rounds):
        for _ in range(inner):
            n, s = sums(whole, state, combos, dims, "unit")
            fresh = [by_level(n, combos, v) for v in range(len(variables))]
            held = [(a + b) / 2 for a, b in zip(held, fresh, strict=True)] if held else fresh  # halfway, as all cells move at once
            due = [o.sum(axis=1, keepdims=True) * p for o, p in zip(held, share, strict=True)]
            state = Clusters(unit(s.sum(axis=0)), sigma, [theta * np.log((e + 1) / (o + 1)) for e, o in zip(due, held, strict=True)])
        n, s = sums(whole, state, combos, dims, "z")
        moves = ridge(n, s, combos, lam)
        after = materialize(_moved(now, state, moves, combos), "integration")
        drop_table(now)
        now, whole = after, after.filter("z IS NOT NULL").select("z", "now", "combo")
        if early_stop and last is not None and max(np.abs(a - b).max() for a, b in zip(moves, last, strict=True)) <= tolerance * max(np.abs(a).max() for a in moves):
            break
        last = moves
    return now.select(*[(F.col("now").cast(kinds[emb]) if c == emb else F.col(at[c])).alias(c) for c in cells.columns])


def _moved(table: DataFrame, state: Clusters, moves: list[np.ndarray], combos: np.ndarray) -> DataFrame:
    """The table with ``now`` = z less the memberships' share of each cluster's batch terms."""

    def run(batches):
        for batch in batches:
            whole = np.flatnonzero(batch["z"].is_valid().to_numpy(zero_copy_only=False))
            out: list = [None] * batch.num_rows
            if len(whole):
                own = batch.take(pa.array(whole))
                z, now = columns(own, "z", "now")
                levels = combos[own["combo"].to_numpy()]
                r = state.memberships(now, levels)
                shift = np.zeros_like(z)
                for v, m in enumerate(moves):
                    for level in np.unique(levels[:, v]):
                        at = levels[:, v] == level
                        shift[at] += r[at] @ m[:, level]
                for i, row in zip(whole, z - shift, strict=True):
                    out[i] = row
            at = batch.schema.get_field_index("now")
            yield batch.set_column(at, "now", pa.array(out, pa.list_(pa.float64())))

    return table.mapInArrow(run, table.schema)
