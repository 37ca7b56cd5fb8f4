"""Counts to embeddings: normalisation, z-scores, PCA, smoothing over neighbours."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.vectors import clip
from meshloom.plans.storage import materialize


def normalize(counts: DataFrame, scale: float | None = None) -> DataFrame:
    """counts with ``value`` = log(1 + scale * count / the cell's sum); the scale is the sample's median sum unless given. Cells without counts are absent."""
    sums = counts.groupBy("sample", "cell_id").agg(F.sum("count").alias("total"))
    df = counts.join(sums, ["sample", "cell_id"])
    if scale is None:
        df = df.join(F.broadcast(sums.groupBy("sample").agg(F.median("total").alias("scale"))), "sample")
    else:
        df = df.withColumn("scale", F.lit(float(scale)))
    return df.select("sample", "cell_id", "gene", F.log1p(F.col("scale") * F.col("count") / F.col("total")).alias("value"))


def gene_moments(values: DataFrame, by: str = "gene") -> DataFrame:
    """(sample, by, mu, sd) over all cells (or genes), absent entries counting as zeros; sd with n - 1, null for a single one."""
    other = "cell_id" if by == "gene" else "gene"
    n = values.groupBy("sample").agg(F.countDistinct(other).cast("double").alias("n"))
    m = values.groupBy("sample", by).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.avg("value").alias("m0"), F.count("*").alias("k"), F.var_pop("value").alias("v0"))
    mu = F.col("s") / F.col("n")
    # around the mean, not from raw squares
    spread = F.col("k") * (F.col("v0") + (F.col("m0") - mu) ** 2) + (F.col("n") - F.col("k")) * mu**2
    return m.join(F.broadcast(n), "sample").select("sample", by, mu.alias("mu"), F.sqrt(spread / F.when(F.col("n") > 1, F.col("n") - 1)).alias("sd"))


def variable_genes(values: DataFrame, n: int) -> DataFrame:
    """(sample, gene, dispersion): the ``n`` genes of greatest variance over mean in each sample; ties go to the smaller name."""
    spread = gene_moments(values).select("sample", "gene", (F.col("sd") * F.col("sd") / F.col("mu")).alias("dispersion")).filter("dispersion IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("dispersion"), "gene"))
    return spread.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def z_scores(values: DataFrame, margin: int = 1, limit: float = 10.0) -> DataFrame:
    """(sample, cell_id, gene, z) for every cell and gene of a sample, clipped to the limit; by gene (margin 1) or by cell (2).

    Genes (cells) without spread have a null z. The result is dense by definition: cells times genes.
    """
    by = "gene" if margin == 1 else "cell_id"
    cells, genes = values.select("sample", "cell_id").distinct(), values.select("sample", "gene").distinct()
    dense = cells.join(genes, "sample").join(values, ["sample", "cell_id", "gene"], "left").join(gene_moments(values, by), ["sample", by])
    z = (F.coalesce("value", F.lit(0.0)) - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd"))
    return dense.select("sample", "cell_id", "gene", clip(z, -limit, limit).alias("z"))


def pca(counts: DataFrame, npcs: int = 25) -> tuple[DataFrame, DataFrame]:
    """``pca_of`` normalised counts. These are written once, as several passes go over them."""
    return pca_of(materialize(normalize(materialize(counts, "counts")), "normalized"), npcs)


#: Directions beyond those asked for in a block; entries of all samples' spaces that are worked on at once; entries of cells that a task multiplies at once; blocks that a space has room for at least.
EXTRA, BASES, CHUNK, SPACE = 10, 20_000_000, 50_000, 4


def pca_of(values: DataFrame, npcs: int = 25, tolerance: float = 1e-8, max_rounds: int = 300) -> tuple[DataFrame, DataFrame]:
    """(embeddings(sample, cell_id, emb), loadings(sample, gene, loading)) of the z-scores of values, without a table of cells times genes.

    The z-scores of a sample are those of absent values (one number a gene) plus a sparse matrix, so products with them need the entries that there are alone. In a round
    each task multiplies its rows with a block of ``npcs`` directions and a few more and adds up the products' products, genes x directions, in one pass over the cells; these are summed by gene on the
    driver (a panel's genes, ``BASES`` entries at once, samples in turns beyond that). The directions are the best in the space of all blocks so far; what they are off by is
    the next block. A space that takes in all genes is exact, so genes / block rounds are enough at any spectrum, however flat; one without room (``BASES``) goes on from its leading directions. It ends when no
    direction asked for is off by more than ``tolerance`` of the greatest. The sign of a component makes its largest loading positive; components beyond the rank are left out.
    """
    spark = values.sparkSession
    kinds = dict(values.dtypes)
    m = gene_moments(values).filter("sd > 0")
    limit = 10.0
    z = lambda x: clip((x - F.col("mu")) / F.col("sd"), -limit, limit)
    panel: dict = {}
    for r in m.select("sample", "gene", z(F.lit(0.0)).alias("z0")).collect():  # a row a gene of each sample
        panel.setdefault(r["sample"], []).append((r["gene"], r["z0"]))
    cells = values.select("sample", "cell_id").distinct()
    entry = F.struct(F.col("gene"), (z(F.col("value")) - z(F.lit(0.0))).alias("v"))
    rows = values.join(m.select("sample", "gene", "mu", "sd"), ["sample", "gene"]).groupBy("sample", "cell_id").agg(F.collect_list(entry).alias("row"))
    none = F.array().cast(f"array<struct<gene:{kinds['gene']},v:double>>")
    rows = materialize(cells.join(rows, ["sample", "cell_id"], "left").select("sample", "cell_id", F.coalesce("row", none).alias("row")), "sparse")
    turns: list[list] = [[]]
    for sample in sorted(panel, key=str):
        if turns[-1] and sum(len(panel[s]) for s in [*turns[-1], sample]) * SPACE * (npcs + EXTRA) > BASES:
            turns.append([])
        turns[-1].append(sample)
    emb, loadings = [], []
    for turn in turns:
        found = _leading(rows, {s: panel[s] for s in turn}, npcs, tolerance, max_rounds)
        loadings += [(s, gene, u.tolist()) for s, (genes, _, basis) in found.items() for gene, u in zip(genes, basis, strict=True)]
        emb.append(_projected(rows, found, f"sample {kinds['sample']}, cell_id {kinds['cell_id']}, emb array<double>"))
    return reduce(DataFrame.unionByName, emb), spark.createDataFrame(loadings, f"sample {kinds['sample']}, gene {kinds['gene']}, loading array<double>")


def _sparse(batch: pa.RecordBatch, bases: dict):
    """For each sample of the batch that ``bases`` (sample: genes, absent z-scores, basis) knows: (sample, rows of the batch, entries' row, gene and value), about ``CHUNK`` entries at once."""
    samples, lists = np.array(batch["sample"].to_pylist(), object), batch["row"]
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    names, v, starts = flat.field("gene").to_pylist(), flat.field("v").to_numpy(), np.concatenate([[0], np.cumsum(size)])
    for s in set(samples.tolist()) & set(bases):
        place = {g: i for i, g in enumerate(bases[s][0])}
        held, n = [], 0
        mine = np.flatnonzero(samples == s)
        for last, i in enumerate(mine, 1):
            held.append(i)
            n += size[i]
            if n >= CHUNK or last == len(mine):
                at = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in held])
                yield s, held, np.repeat(np.arange(len(held)), size[held]), np.array([place[names[j]] for j in at], int), v[at]
                held, n = [], 0


def _times(z0: np.ndarray, basis: np.ndarray, n: int, row: np.ndarray, gene: np.ndarray, v: np.ndarray) -> np.ndarray:
    """z-scores of ``n`` cells, times the basis."""
    out = np.tile(z0 @ basis, (n, 1))
    np.add.at(out, row, v[:, None] * basis[gene])
    return out


def _leading(rows: DataFrame, panel: dict, npcs: int, tolerance: float, max_rounds: int) -> dict:
    """{sample: (genes, absent z-scores, loadings)}: the leading directions, each round's the best in the space of all blocks so far."""
    bases, spaces, done = {}, {}, {}
    most = BASES // max(1, sum(map(len, panel.values())))  # columns of a space
    for s, genes in panel.items():
        genes = sorted(genes)
        width = min(len(genes), npcs + EXTRA)
        start = np.eye(len(genes)) if width == len(genes) else np.linalg.qr(np.random.default_rng(len(genes)).normal(size=(len(genes), width)))[0]
        bases[s] = [g for g, _ in genes], np.array([x for _, x in genes]), start
        spaces[s] = np.zeros((len(genes), 0)), np.zeros((len(genes), 0))
    names = list(bases)
    for turn_no in range(max_rounds):
        if not bases:
            return done
        again = _round(rows, bases, names)
        for s, product in again.items():
            genes, z0, block = bases[s]
            basis, image = (np.hstack(both) for both in zip(spaces[s], (block, product), strict=True))
            inner = basis.T @ image
            value, turn = np.linalg.eigh((inner + inner.T) / 2)
            value, turn = value[::-1], turn[:, ::-1]
            order = [i for i in range(min(npcs, len(value))) if value[i] > 1e-9 * value[0]]
            u = basis @ turn[:, order]
            off = np.linalg.norm(image @ turn[:, order] - u * value[order], axis=0)
            if not order or off.max() <= tolerance * value[0] or basis.shape[1] == len(genes):
                sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) if len(u) else 1.0
                done[s] = genes, z0, u * sign
                del bases[s], spaces[s]
                continue
            width = npcs + EXTRA
            rest = (image @ turn[:, :width] - basis @ turn[:, :width] * value[:width]) / value[0]
            if basis.shape[1] + width > max(most, SPACE * width):
                basis, image = basis @ turn[:, : 2 * width], image @ turn[:, : 2 * width]
            spaces[s] = basis, image
            bases[s] = genes, z0, _beside(rest[:, : len(genes) - basis.shape[1]], basis, turn_no)
    if not bases:
        return done
    raise RuntimeError(f"the leading directions did not settle in {max_rounds} rounds")


def _beside(block: np.ndarray, basis: np.ndarray, seed: int) -> np.ndarray:
    """The block's directions, orthonormal and at right angles to the basis; a random one in place of each that is nothing."""
    size = np.linalg.norm(block, axis=0)
    other = np.random.default_rng(seed).normal(size=block.shape)
    block = np.where(size > 1e-12, block / np.maximum(size, 1e-300), other)
    for _ in range(3):  # what rounding leaves along the basis goes with the next pass
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    return block


def _round(rows: DataFrame, bases: dict, names: list) -> dict:
    """{sample: Z'Z times its basis}, in one pass over the cells."""
    held = dict(bases)
    number = {s: names.index(s) for s in held}
    width = max(b[2].shape[1] for b in held.values())

    def run(batches):
        total = {s: np.zeros((len(z0) + 1, basis.shape[1])) for s, (_, z0, basis) in held.items()}
        for batch in batches:
            for s, cells, row, gene, v in _sparse(batch, held):
                y = _times(held[s][1], held[s][2], len(cells), row, gene, v)
                total[s][-1] += y.sum(axis=0)
                for j in range(y.shape[1]):
                    total[s][:-1, j] += np.bincount(gene, v * y[row, j], len(total[s]) - 1)
        for s, t in total.items():
            some = np.flatnonzero(np.abs(t).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number[s], np.int32)), pa.array(some.astype(np.int32)), pa.array(t[some].tolist(), pa.list_(pa.float64()))], ["s", "gene", "w"])

    parts = rows.filter(F.size("row") >= 0).select("sample", "row").mapInArrow(run, "s int, gene int, w array<double>")
    out = {s: np.zeros((len(z0) + 1, basis.shape[1])) for s, (_, z0, basis) in held.items()}
    for r in parts.groupBy("s", "gene").agg(*[F.sum(F.get("w", F.lit(i))) for i in range(width)]).collect():  # a row a gene
        out[names[r[0]]][r[1]] = r[2 : 2 + out[names[r[0]]].shape[1]]
    return {s: t[:-1] + np.outer(held[s][1], t[-1]) for s, t in out.items()}


def _projected(rows: DataFrame, found: dict, schema: str) -> DataFrame:
    """Embeddings of the cells of the samples at hand."""

    def run(batches):
        for batch in batches:
            for s, cells, row, gene, v in _sparse(batch, found):
                y = _times(found[s][1], found[s][2], len(cells), row, gene, v)
                own = batch.take(pa.array(cells))
                yield pa.RecordBatch.from_arrays([own["sample"], own["cell_id"], pa.array(y.tolist(), pa.list_(pa.float64()))], ["sample", "cell_id", "emb"])

    return rows.mapInArrow(run, schema)


def smooth_embedding(cells: DataFrame, adjacency: DataFrame, dims: int, rounds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(sample, cell_id, emb): embeddings after each number of ``rounds`` of averaging over a cell and its neighbours, side by side (0: as they are)."""
    if not rounds or min(rounds) < 0:
        raise ValueError("rounds must be numbers of 0 or more")
    own = cells.select("sample", F.col("cell_id").alias("a"), F.col("cell_id").alias("b"))
    links = adjacency.select("sample", "a", "b").unionByName(own)
    now = cells.select("sample", "cell_id", F.col("emb").alias("e0"))
    for k in range(1, max(rounds) + 1):
        last = now.select("sample", F.col("cell_id").alias("b"), F.col(f"e{k - 1}").alias("v"))
        means = links.join(last, ["sample", "b"]).groupBy("sample", F.col("a").alias("cell_id")).agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dims)]).alias(f"e{k}"))
        now = now.join(means, ["sample", "cell_id"])
    return now.select("sample", "cell_id", F.concat(*[F.col(f"e{k}") for k in rounds]).alias("emb"))


def smooth_loadings(loadings: DataFrame, rounds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Loadings repeated to the width of the smoothed embeddings."""
    return loadings.withColumn("loading", F.flatten(F.array_repeat("loading", len(rounds))))
