"""Readers of tables, and the cell and count views that the tiling operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in a folder for each value of ``by``; an existing path is an error."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def cells(spark: SparkSession, folder: str, dims: int = 8) -> DataFrame:
    """(sample, cell_id, x, y, emb): the first two components of an embedding are the place, the next ``dims`` the features."""
    e = F.col("embedding")
    place = [e[i].cast("double") for i in range(2)]
    features = F.array(*[e[i + 2].cast("double") for i in range(dims)])
    rows = read(spark, folder, "embeddings").filter("label IS NOT NULL AND vec_id IS NOT NULL")
    return rows.select(F.col("label").alias("sample"), F.col("vec_id").alias("cell_id"), place[0].alias("x"), place[1].alias("y"), features.alias("emb"))


def supplier_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, cell_id, gene, count): a supplier's quantity of each brand; one sample."""
    lines = read(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    parts = read(spark, folder, "part").select("p_partkey", "p_brand")
    summed = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    joined = summed.join(parts, summed.l_partkey == parts.p_partkey)
    return joined.groupBy(F.lit(0).alias("sample"), F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("q").cast("double").alias("count"))


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, cell_id, gene, count): how often a user had each kind of event; one sample."""
    return read(spark, folder, "events").groupBy(F.lit(0).alias("sample"), F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene")).agg(F.count("*").cast("double").alias("count"))


def embedding_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, cell_id, gene, count): a hundred times each component above zero, rounded down, of labelled embeddings."""
    e = read(spark, folder, "embeddings").filter("label IS NOT NULL AND vec_id IS NOT NULL").select(F.col("label").alias("sample"), F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("at", "x"))
    return e.select("sample", "cell_id", F.concat(F.lit("g"), "at").alias("gene"), F.floor(100 * F.col("x").cast("double")).cast("double").alias("count")).filter("count > 0")


def supplier_meta(spark: SparkSession, folder: str) -> DataFrame:
    """(cell_id, nation, region) of suppliers."""
    s, n, r = (read(spark, folder, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("cell_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
