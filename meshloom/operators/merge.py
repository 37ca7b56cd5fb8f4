"""Agglomeration of neighbouring tiles: scores by similarity, size and compactness, and greedy merging."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.functions.vectors import distance
from meshloom.plans.storage import materialize

GROW, FILL, STATIC = 2, 3, 1
OUT = -1.0


def fit_mixture(d: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Mean and standard deviation of the lower of two normal components of one-dimensional data.

    Expectation-maximisation from the halves about the median, with equal and with free variances; the better by the Bayesian
    information criterion counts. Fewer than four values, or equal ones, give their own mean and deviation (1 if that is zero).
    """
    d = np.sort(np.asarray(d, float))
    if len(d) < 4 or d[0] == d[-1]:
        return (float(d.mean()), float(d.std()) or 1.0) if len(d) else (0.0, 1.0)
    floor = max(1e-8 * float(d.var()), 1e-300)
    best = None
    for free in (False, True):
        share = np.zeros((2, len(d)))
        share[0, : len(d) // 2] = 1
        share[1] = 1 - share[0]
        last = -np.inf
        for _ in range(rounds):
            n = np.maximum(share.sum(axis=1), 1e-12)
            mean = share @ d / n
            var = (share * (d - mean[:, None]) ** 2).sum(axis=1)
            var = np.maximum(var / n if free else np.full(2, var.sum() / len(d)), floor)
            log = np.log(n / len(d))[:, None] - 0.5 * (np.log(2 * math.pi * var)[:, None] + (d - mean[:, None]) ** 2 / var[:, None])
            top = log.max(axis=0)
            like = top + np.log(np.exp(log - top).sum(axis=0))
            share = np.exp(log - like)
            if abs(like.sum() - last) < 1e-9 * abs(like.sum()) + 1e-12:
                break
            last = like.sum()
        bic = 2 * like.sum() - (5 if free else 4) * math.log(len(d))
        if best is None or bic > best[0]:
            low = int(mean.argmin())
            best = (bic, float(mean[low]), float(math.sqrt(var[low])))
    return best[1], best[2]


def border_distances(edges: DataFrame, tiles: DataFrame, dims: int) -> DataFrame:
    """Tile edges with ``d``, the distance of their ends' embeddings, and both ends' npts, area and perimeter (suffixes 0 and 1)."""
    side = lambda n, k: tiles.select("sample", F.col("tile_id").alias(n), *[F.col(c).alias(f"{c}{k}") for c in ("emb", "perimeter")], F.col("npts").alias(f"npts{k}"), F.col("area").alias(f"area{k}"))
    e = edges.select("sample", "from_tile", "to_tile", "edge_length", *[c for c in ("score_size", "dscore") if c in edges.columns])
    e = e.join(side("from_tile", 0), ["sample", "from_tile"]).join(side("to_tile", 1), ["sample", "to_tile"])
    return e.withColumn("d", distance("emb0", "emb1", dims))


def mixtures(scored: DataFrame, mode: int, alpha: float = 1.0) -> DataFrame:
    """(sample, d_mu, d_sig) of each sample's distances ``d``: the lower component's mean plus its deviation, which alpha widens (in mode 3 before it is added)."""
    kind = scored.schema["sample"].dataType
    schema = T.StructType([T.StructField("sample", kind), T.StructField("d_mu", T.DoubleType()), T.StructField("d_sig", T.DoubleType())])

    def kernel(df: pd.DataFrame) -> pd.DataFrame:
        mean, sd = fit_mixture(df["d"].to_numpy())
        return pd.DataFrame({"sample": [df["sample"].iloc[0]], "d_mu": [mean + (sd if mode == GROW else alpha * sd)], "d_sig": [alpha * sd]})

    return scored.select("sample", "d").groupBy("sample").applyInPandas(kernel, schema)


def scores(edges: DataFrame, tiles: DataFrame, params: DataFrame | None, dims: int, mode: int, max_npts: float = 50, min_npts: float = 5, fix_to: bool = False) -> DataFrame:
    """Tile edges with w, score_size, perimeter_merge, dscore, npts, area and emb_merged.

    Mode 1 keeps the ``dscore`` that the edges have (none is an error), with w and score_size 0, and needs no ``params``. Mode 2 grows tiles: similarity about 0, and -1 for a merged size of ``max_npts`` or more. Mode 3 fills up small tiles: similarity from 0 to 1, the size score stays as it is (1 if
    there is none), and -1 where both ends have ``min_npts`` or more. In mode 3 both ends' compactness is the first one's, as published, unless ``fix_to``.
    """
    if mode not in (STATIC, GROW, FILL):
        raise ValueError("mode is 1 (as given), 2 (grow) or 3 (fill)")
    if mode == STATIC and "dscore" not in edges.columns:
        raise ValueError("mode 1 needs edges with dscore")
    e = border_distances(edges, tiles, dims)
    e = e.withColumns({"d_mu": F.lit(0.0), "d_sig": F.lit(1.0)}) if mode == STATIC else e.join(F.broadcast(params), "sample")
    n0, n1 = F.col("npts0").cast("double"), F.col("npts1").cast("double")
    logistic = 1 / (1 + F.exp(-(F.col("d") - F.col("d_mu")) / F.col("d_sig")))
    size = (1 - n0 / max_npts) * (1 - n1 / max_npts)
    if mode == FILL:
        size = F.col("score_size") if "score_size" in edges.columns else F.lit(1.0)
    round_ = lambda k, share: share * (4 * math.pi * F.col(f"area{k}")) / F.col(f"perimeter{k}") ** 2
    e = e.withColumns({"w": (0.5 if mode == GROW else 1.0) - logistic, "score_size": size, "perimeter_merge": F.col("perimeter0") + F.col("perimeter1") - 2 * F.col("edge_length"), "npts": F.col("npts0") + F.col("npts1"), "area": F.col("area0") + F.col("area1")})
    c_to = round_(1 if mode == GROW or fix_to else 0, n1 / (n0 + n1))
    dc = 0.5 * (4 * math.pi * F.col("area") / F.col("perimeter_merge") ** 2 - round_(0, n0 / (n0 + n1)) - c_to + 1)
    never = (F.col("npts") >= max_npts) if mode == GROW else (n0 >= min_npts) & (n1 >= min_npts)
    merged = F.array(*[(n0 * F.col("emb0")[i] + n1 * F.col("emb1")[i]) / (n0 + n1) for i in range(dims)])
    if mode == STATIC:
        e = e.withColumns({"w": F.lit(0.0), "score_size": F.lit(0.0), "dscore": F.col("dscore").cast("double")})
    else:
        e = e.withColumn("dscore", F.when(never, F.lit(OUT)).otherwise(F.col("w") * F.col("score_size") * dc))
    e = e.withColumn("emb_merged", merged)
    return e.select("sample", "from_tile", "to_tile", "edge_length", "npts", "area", "w", "score_size", "perimeter_merge", "dscore", "emb_merged")


class Agglomerator:
    """Greedy merging of one sample's tiles: the best edge first (ties: the first edge), until none reaches the threshold.

    A heap holds an entry for each score an edge has had; stale ones are passed over. Only edges of the surviving tile are scored anew.
    """

    def __init__(self, npts, area, perimeter, emb, ends, length, w, size, per_merge, dscore, emb_merged, d_mu, d_sig, mode, min_npts, max_npts):
        self.npts, self.area, self.perimeter, self.emb = (np.array(v, float) for v in (npts, area, perimeter, emb))
        self.ends = [list(e) for e in ends]
        self.length, self.w, self.size, self.per_merge, self.dscore = (np.array(v, float) for v in (length, w, size, per_merge, dscore))
        self.emb_merged = np.array(emb_merged, float).reshape(len(ends), -1)
        self.d_mu, self.d_sig, self.mode, self.min_npts, self.max_npts = d_mu, d_sig, mode, min_npts, max_npts
        self.e_npts = np.array([self.npts[a] + self.npts[b] for a, b in ends], float)
        self.e_area = np.array([self.area[a] + self.area[b] for a, b in ends], float)
        self.out: list[set[int]] = [set() for _ in npts]  # edges that begin at a tile, and that end there
        self.into: list[set[int]] = [set() for _ in npts]
        for i, (a, b) in enumerate(ends):
            self.out[a].add(i)
            self.into[b].add(i)
        self.group = [[i] for i in range(len(npts))]

    def _score(self, i: int) -> None:
        a, b = self.ends[i]
        n0, n1 = self.npts[a], self.npts[b]
        n = n0 + n1
        self.e_npts[i], self.e_area[i] = n, self.area[a] + self.area[b]
        self.emb_merged[i] = self.emb[a] * (n0 / n) + self.emb[b] * (n1 / n)
        p = self.per_merge[i] = self.perimeter[a] + self.perimeter[b] - 2 * self.length[i]
        if self.mode == STATIC:
            return
        z = (math.dist(self.emb[a], self.emb[b]) - self.d_mu) / self.d_sig
        logistic = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        self.w[i] = (0.5 if self.mode == GROW else 1.0) - logistic
        self.size[i] = (1 - n0 / self.max_npts) * (1 - n1 / self.max_npts)
        roundness = lambda area, per: 4 * math.pi * area / (per * per) if per else math.inf
        dc = 0.5 * (roundness(self.e_area[i], p) - n0 / n * roundness(self.area[a], self.perimeter[a]) - n1 / n * roundness(self.area[b], self.perimeter[b]) + 1)
        never = n >= self.max_npts if self.mode == GROW else n0 >= self.min_npts and n1 >= self.min_npts
        self.dscore[i] = OUT if never else self.w[i] * self.size[i] * dc

    def run(self, threshold: float = 0.0, rounds: int | None = None) -> Agglomerator:
        heap = [(-s, i) for i, s in enumerate(self.dscore) if s >= threshold]
        heapq.heapify(heap)
        left = len(self.npts) - 1 if rounds is None else min(rounds, len(self.npts) - 1)
        while heap and left > 0:
            s, i = heapq.heappop(heap)
            if -s != self.dscore[i]:
                continue
            left -= 1
            a, b = self.ends[i]
            self.dscore[i] = -math.inf
            self.group[a] += self.group[b]
            self.group[b] = []
            self.emb[a], self.area[a], self.npts[a] = self.emb_merged[i], self.e_area[i], self.e_npts[i]
            self.perimeter[a] += self.perimeter[b] - 2 * self.length[i]
            for side, edges in ((0, self.out), (1, self.into)):
                for k in edges[b]:
                    self.ends[k][side] = a
                edges[a] |= edges[b]
                edges[b] = set()
            self.out[a].discard(i)
            self.into[a].discard(i)
            first: dict[int, int] = {}
            for k in [*sorted(self.out[a]), *sorted(self.into[a])]:
                other = self.ends[k][1] if self.ends[k][0] == a else self.ends[k][0]
                if other not in first:
                    first[other] = k
                    continue
                self.length[first[other]] += self.length[k]
                self.dscore[k] = -math.inf
                for edges in (self.out, self.into):
                    edges[a].discard(k)
                    edges[other].discard(k)
            for k in sorted(first.values()):
                self._score(k)
                if self.dscore[k] >= threshold:
                    heapq.heappush(heap, (-self.dscore[k], k))
        return self


def merge_tiles(tiles: DataFrame, edges: DataFrame, params: DataFrame | None, mode: int, max_npts: float = math.inf, min_npts: float = 0, threshold: float = 0.0, rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(map(sample, tile_id, new_id), tiles, edges) after greedy merging of each sample.

    Survivors are the ``from_tile`` of each merge, numbered anew in their old order. Tiles of unknown area or perimeter don't spoil others: they count as zero.
    Merging is sequential within a sample, which is one task; samples run side by side.
    """
    sample = tiles.schema["sample"]
    number = T.LongType()
    t_schema = T.StructType([sample, T.StructField("tile_id", number), T.StructField("new_id", number), T.StructField("npts", T.DoubleType()), T.StructField("area", T.DoubleType()), T.StructField("perimeter", T.DoubleType()), T.StructField("emb", T.ArrayType(T.DoubleType())), T.StructField("edge", T.ArrayType(T.DoubleType()))])

    def kernel(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=t_schema.names)
        t = t.sort_values("tile_id").reset_index(drop=True)
        at = {v: i for i, v in enumerate(t["tile_id"])}
        e = e.sort_values(["from_tile", "to_tile"]).reset_index(drop=True)
        ends = [(at[a], at[b]) for a, b in zip(e["from_tile"], e["to_tile"], strict=True)]
        mu, sig = (e["d_mu"].iloc[0], e["d_sig"].iloc[0]) if len(e) else (0.0, 1.0)
        m = Agglomerator(t["npts"], t["area"].fillna(0), t["perimeter"].fillna(0), list(t["emb"]), ends, e["edge_length"], e["w"], e["score_size"], e["perimeter_merge"], e["dscore"], list(e["emb_merged"]), mu, sig, mode, min_npts, max_npts).run(threshold, rounds)
        new, last = {}, 0
        for g in m.group:
            if g:
                last += 1
                new |= dict.fromkeys(g, last)
        name = t["sample"].iloc[0]
        rows = [(name, int(t["tile_id"][j]), new[j], *((m.npts[j], m.area[j], m.perimeter[j], m.emb[j].tolist()) if m.group[j] else (None, None, None, None)), None) for j in range(len(t))]
        for i, (a, b) in enumerate(m.ends):
            if m.dscore[i] != -math.inf:
                rows.append((name, None, None, None, None, None, None, [float(new[a]), float(new[b]), m.length[i], m.e_npts[i], m.e_area[i], m.w[i], m.size[i], m.per_merge[i], m.dscore[i], *m.emb_merged[i].tolist()]))
        return pd.DataFrame(rows, columns=t_schema.names)

    own = ["sample", "tile_id", "npts", "area", "perimeter", "emb"]
    given = edges.withColumns({"d_mu": F.lit(0.0), "d_sig": F.lit(1.0)}) if params is None else edges.join(F.broadcast(params), "sample")
    # new names for both sides, which may come from one table
    sides = tiles.select(*own).toDF(*own).groupBy("sample").cogroup(given.toDF(*given.columns).groupBy("sample"))
    out = materialize(sides.applyInPandas(kernel, t_schema), "merged")
    mapping = out.filter("tile_id IS NOT NULL").select("sample", "tile_id", "new_id")
    kept = out.filter("npts IS NOT NULL").select("sample", F.col("new_id").alias("tile_id"), F.col("npts").cast("long").alias("npts"), "area", "perimeter", "emb")
    g = F.col("edge")
    names = ("edge_length", "npts", "area", "w", "score_size", "perimeter_merge", "dscore")
    joined = out.filter("edge IS NOT NULL").select("sample", g[0].cast("long").alias("from_tile"), g[1].cast("long").alias("to_tile"), *[g[i + 2].alias(n) for i, n in enumerate(names)], F.slice(g, len(names) + 3, 1_000_000).alias("emb_merged"))
    low = F.col("from_tile") < F.col("to_tile")
    joined = joined.withColumns({"from_tile": F.when(low, F.col("from_tile")).otherwise(F.col("to_tile")), "to_tile": F.when(low, F.col("to_tile")).otherwise(F.col("from_tile")), "npts": F.col("npts").cast("long")})
    return mapping, kept, joined


def relabel(tiles_of_points: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sample, pt_id, tile_id) with the ids that tiles have after merging."""
    return tiles_of_points.join(mapping, ["sample", "tile_id"]).select("sample", "pt_id", F.col("new_id").alias("tile_id"))
