"""Helpers for tables of cells and tiles: grouping, aggregation, labels, neighbour graphs, communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.vectors import mean_arrays
from meshloom.operators.community import leiden
from meshloom.operators.graph import dealt_join, ranked
from meshloom.operators.integrate import integrate
from meshloom.operators.layout import umap
from meshloom.operators.neighbours import descend
from meshloom.plans.storage import materialize


def group_matrix(cells: DataFrame, group: str, cell: str = "cell_id") -> DataFrame:
    """(group, cell, value 1): the one-hot matrix of a label in long form; cells without a label have no entry."""
    return cells.filter(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(cell).alias("cell"), F.lit(1).alias("value"))


def aggregate_embeddings(cells: DataFrame, group: str, dims: int, levels: DataFrame | None = None, how: str = "mean", emb: str = "emb") -> DataFrame:
    """(group, emb): mean or sum of the embeddings of each group; ``levels`` (group) adds groups without cells, with a null embedding."""
    if how not in ("mean", "sum"):
        raise ValueError("how is mean or sum")
    rows = cells.filter(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(emb).alias("emb"))
    if how == "mean":
        out = mean_arrays(rows, ["group"], ["emb"], dims)
    else:
        out = rows.groupBy("group").agg(F.array(*[F.sum(F.col("emb")[i]) for i in range(dims)]).alias("emb"))
    return levels.join(out, "group", "left") if levels is not None else out


def levels(df: DataFrame, label: str, most: int = 10_000) -> list:
    """The label's distinct values in order, without null. They become columns or names on the driver, so more than ``most`` are an error."""
    found = [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{label} has more than {most} values")
    return sorted(found)


def transposed(aggregated: DataFrame, groups: list) -> DataFrame:
    """(dim, a column for each group): aggregated embeddings turned round."""
    long = aggregated.select("group", F.posexplode("emb").alias("dim", "v"))
    return long.groupBy("dim").pivot("group", groups).agg(F.first("v"))


def add_tile_metadata(cells: DataFrame, tiles: DataFrame, columns: dict[str, str], tile: str = "tile_id") -> DataFrame:
    """Cells with columns of their tiles, renamed as ``columns`` says (tile column: name); cells without a tile get nulls."""
    side = tiles.select(tile, *[F.col(k).alias(v) for k, v in columns.items()])
    return cells.join(side, tile, "left")


def merge_clusters(df: DataFrame, label: str, merged: list, name: str) -> tuple[DataFrame, list]:
    """The labels ``merged`` become ``name``; also the order of levels: the others as sorted, the new one last. An unknown label is an error."""
    known = levels(df, label)
    if unknown := [m for m in merged if m not in known]:
        raise ValueError(f"no such label: {unknown}")
    c = F.col(label)
    return df.withColumn(label, F.when(c.isin(merged), F.lit(name)).otherwise(c.cast("string"))), [*[str(x) for x in known if x not in merged], name]


def add_subcluster_labels(df: DataFrame, sub: DataFrame, cluster: str, label: str, key: str = "cell_id", sub_label: str = "sub") -> DataFrame:
    """Rows of a cluster get "<cluster>_<sub>" in place of it, from ``sub`` (key, sub_label). Rows of the cluster that ``sub`` lacks are an error."""
    if df.filter(F.col(label) == cluster).join(sub, key, "left_anti").limit(1).count():
        raise ValueError("some rows of the cluster have no label within it")
    joined = df.join(sub.select(key, F.col(sub_label).alias("__sub")), key, "left")
    both = F.concat_ws("_", F.col(label), F.col("__sub").cast("string"))
    return joined.withColumn(label, F.when((F.col(label) == cluster) & F.col("__sub").isNotNull(), both).otherwise(F.col(label))).drop("__sub")


def subcluster_levels(known: list, cluster: str, subs: list) -> list[str]:
    """The order of levels after a split: in the cluster's place "<cluster>_<sub>" for each of ``subs`` in their order. An unknown cluster is an error."""
    at = known.index(cluster)
    return [*map(str, known[:at]), *[f"{cluster}_{s}" for s in subs], *map(str, known[at + 1 :])]


#: Vectors that cuts are chosen from, for each cell of the search and in all.
SEEN, SEEN_AT_MOST = 32, 65_536


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of ``depth`` levels, node i above 2i + 1 and 2i + 2: the component that each node cuts (its widest) and where (the median)."""
    axis, cut, held = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1), [sample]
    for i in range(len(axis)):
        own, held[i] = held[i], None
        if len(own):
            axis[i] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cut[i] = np.median(own[:, axis[i]])
        above = own[:, axis[i]] > cut[i]
        held += [own[~above], own[above]]
    return axis, cut


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _nearest(x: pd.DataFrame, y: pd.DataFrame, k: int, rows: int = 1024):
    """(id, other, distance): the k nearest of each row of ``x`` among those of ``y``, ``rows`` at once; ties to the smaller id."""
    y = y.sort_values("id")
    xi, yi, u, v = x["id"].to_numpy(), y["id"].to_numpy(), np.stack(x["u"].to_numpy()), np.stack(y["u"].to_numpy())
    for a in range(0, len(xi), rows):
        d = np.round(1 - u[a : a + rows] @ v.T, 12)
        own = np.minimum(np.searchsorted(yi, xi[a : a + rows]), len(yi) - 1)
        same = np.flatnonzero(yi[own] == xi[a : a + rows])
        d[same, own[same]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(yi) else np.inf
        i, j = np.nonzero((d <= last) & np.isfinite(d))
        far = d[i, j]
        order = np.lexsort((j, far, i))
        i, j, far = i[order], j[order], far[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield pd.DataFrame({"id": xi[a : a + rows][i[kept]], "other": yi[j[kept]], "distance": far[kept]})


def knn(vectors: DataFrame, k: int = 30, block: int = 1024, key: str = "id", emb: str = "emb", asked: int = 16_384) -> DataFrame:
    """(id, rank, other, distance): the k nearest of each row by cosine distance, exact; ties to the smaller id.

    Unit vectors are dealt to cells of about ``block`` by a tree of cuts, chosen from a bounded sample (which decides where rows lie, not what is found). A row's k nearest in its own cell bound
    the distance of all its neighbours, so it asks those other cells alone whose box is no farther. In few dimensions these are about as many at every size; in many, where boxes say nothing, all
    cells are asked, ``asked`` rows at once. Of equal vectors only the k + 1 of least id can be neighbours, so a vector that a third of all rows have fills no cell.
    """
    kind = dict(vectors.dtypes)[key]
    base = materialize(vectors.filter(F.col(emb).isNotNull()).select(F.col(key).alias("id"), F.col(emb).cast("array<double>").alias("v")), "knn-vectors")
    total = base.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(total / block, SEEN_AT_MOST / SEEN))))))
    some = pd.DataFrame({"v": [r[0] for r in base.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < SEEN * 2**depth).select("v").collect()]}) if depth else None
    seen = _units(some["v"]) if depth and len(some) else np.zeros((0, 1))
    axis, cut = _cuts(seen[np.isfinite(seen).all(axis=1)], depth)

    def dealt(batches):
        for df in batches:
            if len(df):
                u, at = _units(df["v"]), np.zeros(len(df), int)
                for _ in range(depth):
                    at = 2 * at + 1 + (u[np.arange(len(u)), axis[at]] > cut[at])
                ok = np.isfinite(u).all(axis=1)  # others are near nothing
                yield pd.DataFrame({"id": df["id"].to_numpy()[ok], "u": pd.Series(list(u[ok]), dtype=object), "zero": ~u[ok].any(axis=1), "cell": at[ok]})

    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    among = base.withColumn("first", first).filter(F.col("first") <= k + 1).select("id", "v")
    lists = f"id {kind}, other {kind}, distance double"
    place = f"id {kind}, u array<double>, zero boolean, cell long"
    held, rows = (materialize(df.mapInPandas(dealt, place), "knn-cells") for df in (among, base))
    boxes = held.select("cell", F.posexplode("u").alias("i", "x")).groupBy("cell", "i").agg(F.min("x"), F.max("x")).collect()  # a row a cell and dimension
    width = max((r[1] for r in boxes), default=0) + 1
    cells = sorted({r[0] for r in boxes})
    number, low, high = {c: n for n, c in enumerate(cells)}, np.zeros((len(cells), width)), np.zeros((len(cells), width))
    for c, i, lo, hi in boxes:
        low[number[c], i], high[number[c], i] = lo, hi

    def searched(asking: DataFrame) -> DataFrame:
        """Lists of (id, u, cell) in the cells asked; so many rows ask a cell at once."""
        n = asking.groupBy("cell").agg(F.ceil(F.count("*") / asked).alias("n"))  # a row a cell
        ask = asking.join(F.broadcast(n), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("n")))
        there = held.join(F.broadcast(n), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        spread = max(1, len(cells) // 2)  # a number, as small partitions are put together otherwise and cells wait for each other
        ask, there = (df.select("id", "u", "cell", "part").repartition(spread, "cell", "part") for df in (ask, there))
        ask, there = ask.toDF(*ask.columns), there.toDF(*there.columns)  # new names, as both come from one table
        work = lambda x, y: pd.concat(_nearest(x, y, k)) if len(x) and len(y) else pd.DataFrame(columns=["id", "other", "distance"])
        return ask.groupBy("cell", "part").cogroup(there.groupBy("cell", "part")).applyInPandas(work, lists)

    def others(batches):
        for df in batches:
            for a in range(0, len(df), 1024):
                u, last = np.stack(df["u"].iloc[a : a + 1024].to_numpy()), df["last"].iloc[a : a + 1024].to_numpy()
                gap = np.zeros((len(u), len(cells)))
                for i in range(width):
                    gap += np.maximum(np.maximum(low[:, i] - u[:, i, None], u[:, i, None] - high[:, i]), 0) ** 2
                # half the squared gap is no more than the distance; distances are rounded to 12 digits
                own = np.array([number.get(c, -1) for c in df["cell"].iloc[a : a + 1024]])
                i, j = np.nonzero((gap / 2 <= last[:, None] + 1e-11) & (np.arange(len(cells)) != own[:, None]))
                # an empty list of vectors would count as numbers
                yield pd.DataFrame({"id": df["id"].iloc[a : a + 1024].to_numpy()[i], "u": pd.Series(list(u[i]), dtype=object), "cell": np.array(cells, int)[j]})

    near = rows.filter("NOT zero")
    inside = materialize(searched(near.select("id", "u", "cell")), "knn-inside")
    ends = inside.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
    bound = near.join(ends, "id", "left").select("id", "u", "cell", F.when(F.col("n") >= k, F.col("last")).otherwise(float("inf")).alias("last"))
    asking = materialize(bound.mapInPandas(others, f"id {kind}, u array<double>, cell long"), "knn-asking")
    # all rows are at distance 1 of a zero vector
    least = F.broadcast(rows.select(F.col("id").alias("other")).orderBy("other").limit(k + 1))
    nowhere = rows.filter("zero").select("id").crossJoin(least).filter("id <> other").select("id", "other", F.lit(1.0).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    found = inside.unionByName(searched(asking)).unionByName(nowhere)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "other", "distance")


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """(id, other, weight), both directions: the fuzzy union of local neighbourhoods.

    In each row's list, rho is the least positive distance and sigma is such that the memberships exp(-(d - rho) / sigma) sum to log2 of the list's length;
    a and b of the two directions become a + b - ab.
    """
    kind = dict(neighbours.dtypes)["id"]
    lists = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "distance"))).alias("l"))

    def kernel(batches):
        for df in batches:
            if not len(df):
                continue
            size = df["l"].map(len).to_numpy()
            there = np.arange(size.max()) < size[:, None]  # a row for each list, filled up with infinite distances
            d = np.full(there.shape, np.inf)
            d[there] = [e["distance"] for l in df["l"] for e in l]
            rho = np.where(d > 0, d, np.inf).min(axis=1)
            far = np.maximum(d - np.where(np.isfinite(rho), rho, 0.0)[:, None], 0)
            target, low, high, sigma = np.log2(np.maximum(size, 2)), np.zeros(len(df)), np.full(len(df), np.inf), np.ones(len(df))
            for _ in range(64):
                s = np.exp(-far / sigma[:, None]).sum(axis=1)
                open_ = np.abs(s - target) >= 1e-5
                if not open_.any():
                    break
                low, high = np.where(open_ & (s <= target), sigma, low), np.where(open_ & (s > target), sigma, high)
                sigma = np.where(open_, np.where(np.isfinite(high), (low + high) / 2, sigma * 2), sigma)
            sigma = np.maximum(np.maximum(sigma, 1e-3 * np.where(there, d, 0.0).sum(axis=1) / size), 1e-12)
            yield pd.DataFrame({"id": np.repeat(df["id"].to_numpy(), size), "other": [e["other"] for l in df["l"] for e in l], "weight": np.exp(-far / sigma[:, None])[there]})

    # written, as both directions of it are read
    one = materialize(lists.mapInPandas(kernel, f"id {kind}, other {kind}, weight double"), "memberships")
    two = one.select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("weight").alias("back"))
    joined = one.join(two, ["id", "other"], "full").select("id", "other", F.coalesce("weight", F.lit(0.0)).alias("a"), F.coalesce("back", F.lit(0.0)).alias("b"))
    return joined.select("id", "other", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def communities(graph: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) of a neighbour graph's nodes (``community.leiden``), numbered from 0 in the order of their smallest members."""
    found = materialize(leiden(graph, resolution), "communities")
    names = ranked(found.select("community").distinct(), [], ["community"]).select(F.col("community").alias("__name"), (F.col("rank") - 1).alias("__number"))
    return dealt_join(found.withColumnRenamed("community", "__name"), names, ["__name"], "id").select("id", F.col("__number").alias("community"))


def layout(graph: DataFrame, epochs: int = 200, seed: int = 0) -> DataFrame:
    """(id, u, v): a two-dimensional layout of a fuzzy graph (``layout.umap``)."""
    return umap(graph, epochs=epochs, seed=seed).select("id", F.col("at")[0].alias("u"), F.col("at")[1].alias("v"))


def neighbour_graph(vectors: DataFrame, k: int = 30, exact: bool = False) -> DataFrame:
    """The fuzzy graph of vectors (id, emb): of neighbours found by descent, whose work grows little faster than the vectors, or with ``exact`` by ``knn``."""
    return fuzzy_graph(materialize(knn(vectors, k) if exact else descend(vectors, k), "neighbours"))


def subcluster(cells: DataFrame, cluster: str, label: str, k: int = 30, resolution: float = 1.0, key: str = "cell_id", emb: str = "emb", batches: tuple[str, ...] = (), dims: int | None = None) -> DataFrame:
    """``cells`` with the rows of a cluster relabelled by the communities of their neighbour graph. ``batches`` names columns whose effect is taken out of the cluster's embeddings (of ``dims`` components) first."""
    own = cells.filter(F.col(label) == cluster).select(F.col(key).alias("id"), F.col(emb).alias("emb"), *[F.col(b).alias(f"__b{i}") for i, b in enumerate(batches)])
    if batches:
        own = integrate(own, [f"__b{i}" for i in range(len(batches))], dims, key="id")
    found = communities(neighbour_graph(own.select("id", "emb"), k), resolution)
    sub = own.select("id").join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("community", F.lit(-1)).alias("sub"))
    return add_subcluster_labels(cells, sub, cluster, label, key)


def subcluster_counts(cells: DataFrame, counts: DataFrame, cluster: str, label: str, genes: int = 2000, npcs: int = 20, k: int = 30, resolution: float = 1.0, batches: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` (cell_id, label, ...) with the rows of a cluster relabelled from its ``counts`` (cell_id, gene, count): normalised, the ``genes`` most variable ones scaled, PCA
    to ``npcs`` components, less the effect of the columns ``batches``, neighbours and communities. Cell ids tell cells apart across samples. Cells without a count in any of these genes get "<cluster>_-1".
    """
    own = cells.filter(F.col(label) == cluster).select("cell_id", *batches)
    found = communities(neighbour_graph(counts_embedded(own, counts, genes, npcs, batches).withColumnRenamed("cell_id", "id"), k), resolution)
    sub = own.select(F.col("cell_id").alias("id")).join(found, "id", "left").select(F.col("id").alias("cell_id"), F.coalesce("community", F.lit(-1)).alias("sub"))
    return add_subcluster_labels(cells, sub, cluster, label)


def counts_embedded(cells: DataFrame, counts: DataFrame, genes: int, npcs: int, batches: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, emb) of ``cells`` (cell_id, batches...) from their ``counts`` (cell_id, gene, count), all as one sample: normalised, the ``genes`` most variable ones, PCA to ``npcs`` components
    (zeros beyond the rank), less the effect of ``batches``. Cells without a count in any of these genes are absent."""
    from meshloom.operators.embed import normalize, pca_of, variable_genes

    own = materialize(counts.join(cells, "cell_id", "left_semi").select(F.lit(0).alias("sample"), "cell_id", "gene", "count"), "counts")
    values = materialize(normalize(own), "normalized")
    kept = materialize(values.join(variable_genes(values, genes).select("sample", "gene"), ["sample", "gene"]), "variable")
    full = F.transform(F.sequence(F.lit(0), F.lit(npcs - 1)), lambda i: F.coalesce(F.get("emb", i), F.lit(0.0)))
    emb = materialize(pca_of(kept, npcs)[0].select("cell_id", full.alias("emb")), "pca")
    if not batches:
        return emb
    names = [f"__b{i}" for i in range(len(batches))]
    named = cells.select("cell_id", *[F.col(b).alias(n) for b, n in zip(batches, names, strict=True)])
    return integrate(emb.join(named, "cell_id"), names, npcs).select("cell_id", "emb")


def tile_subcluster(tiles: DataFrame, cells: DataFrame, cell_adjacency: DataFrame, cluster: str, label: str, dims: int, rounds: tuple[int, ...] = (0, 1), k: int = 30, resolution: float = 1.0) -> DataFrame:
    """``tiles`` with those of a cluster relabelled: their cells' embeddings are smoothed among themselves, averaged by tile and clustered.

    ``cells``: (sample, cell_id, tile_id, emb); ``tiles``: (sample, tile_id, label); tile ids tell tiles apart across samples.
    """
    from meshloom.operators.embed import smooth_embedding

    own = cells.join(tiles.filter(F.col(label) == cluster).select("tile_id"), "tile_id", "left_semi")
    ids = own.select("sample", F.col("cell_id").alias("a"))
    links = cell_adjacency.join(ids, ["sample", "a"], "left_semi").join(ids.withColumnRenamed("a", "b"), ["sample", "b"], "left_semi")
    smooth = smooth_embedding(own, links, dims, rounds).join(own.select("sample", "cell_id", "tile_id"), ["sample", "cell_id"])
    means = aggregate_embeddings(smooth, "tile_id", dims * len(rounds))
    found = communities(neighbour_graph(means.withColumnRenamed("group", "id"), k), resolution)
    every = tiles.filter(F.col(label) == cluster).select(F.col("tile_id").alias("id"))
    sub = every.join(found, "id", "left").select(F.col("id").alias("tile_id"), F.coalesce("community", F.lit(-1)).alias("sub"))
    return add_subcluster_labels(tiles, sub, cluster, label, "tile_id")


def tile_subcluster_counts(tiles: DataFrame, cells: DataFrame, counts: DataFrame, cell_adjacency: DataFrame, cluster: str, label: str, genes: int = 2000, npcs: int = 20, rounds: tuple[int, ...] = (0, 1), k: int = 30, resolution: float = 1.0, batches: tuple[str, ...] = ()) -> DataFrame:
    """``tiles`` with those of a cluster relabelled from their cells' ``counts`` (cell_id, gene, count): the cells' components (``counts_embedded``) are smoothed among themselves, averaged by tile and clustered.

    ``cells``: (sample, cell_id, tile_id, batches...). Cell and tile ids tell them apart across samples. A tile none of whose cells has a count gets "<cluster>_-1".
    """
    own = cells.join(tiles.filter(F.col(label) == cluster).select("tile_id"), "tile_id", "left_semi")
    emb = counts_embedded(own.select("cell_id", *batches), counts, genes, npcs, batches)
    return tile_subcluster(tiles, own.select("sample", "cell_id", "tile_id").join(emb, "cell_id"), cell_adjacency, cluster, label, npcs, rounds, k, resolution)


def scaled_colours(df: DataFrame, emb: str = "emb") -> DataFrame:
    """``df`` with r, g, b from the first three components, each scaled from its least to its greatest value to 0..255."""
    ends = df.agg(*[f(F.col(emb)[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda i: F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), F.round(255 * (F.col(emb)[i] - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}")))).otherwise(0).cast("int")
    return df.crossJoin(F.broadcast(ends)).select(*df.columns, *[scaled(i).alias(c) for i, c in enumerate("rgb")])
