"""Queries op1 to op13 over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    try:
        from public_tokenizers import path

        return path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def op1_hnsw_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.hnsw import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_prefix_forest_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.prefix_forest import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_mincut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.mincut import extract

    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.bytecnn import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.secret_scan import findings

    return findings(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.quality_gam import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.ball_tree import cluster

    return cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


NEAR_DUP_SQL = """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reached(vec_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a), least_of AS (SELECT vec_id, min(other) AS least FROM reached GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(l.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted USING (vec_id) LEFT JOIN least_of l USING (vec_id)
"""

#: A turn a step: each shard's slots are a string in its own order, and the first 0 is what it claims.
PLACEMENT_SQL = """
WITH RECURSIVE named AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard, md5('shard-' || lpad(CAST(i AS VARCHAR), 2, '0')) AS d FROM range(16) t(i)
), orders AS MATERIALIZED (
  SELECT i, shard, CAST('0x' || d[1:8] AS BIGINT) % 2053 AS start, CAST('0x' || d[9:16] AS BIGINT) % 2052 + 1 AS stride FROM named
), listed AS MATERIALIZED (
  SELECT list(start ORDER BY i) AS starts, list(stride ORDER BY i) AS strides, list(inverse ORDER BY i) AS inverses FROM (SELECT o.*, r.r AS inverse FROM orders o JOIN range(1, 2053) r(r) ON o.stride * r.r % 2053 = 1)
), turns(k, slot, free) AS (
  SELECT 0, CAST(NULL AS BIGINT), list_transform(range(16), lambda i: repeat('0', 2053))
  UNION ALL
  SELECT k + 1, taken, list_transform(range(16), lambda j: left(free[j + 1], CAST((taken - starts[j + 1] + 2053) * inverses[j + 1] % 2053 AS BIGINT)) || '1' || substr(free[j + 1], CAST((taken - starts[j + 1] + 2053) * inverses[j + 1] % 2053 AS BIGINT) + 2))
  FROM (SELECT k, free, starts, strides, inverses, (starts[k % 16 + 1] + (instr(free[k % 16 + 1], '0') - 1) * strides[k % 16 + 1]) % 2053 AS taken FROM turns, listed WHERE k < 2053)
), owners AS (SELECT slot, (k - 1) % 16 AS i FROM turns WHERE k > 0)
SELECT doc_id, d.slot, shard FROM (SELECT doc_id, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) % 2053 AS slot FROM documents) d JOIN owners USING (slot) JOIN orders USING (i)
"""

#: Scaled vectors are lists of whole doubles, whose products and sums are exact here.
GAP = "list_dot_product(a.x, a.x) - 2 * list_dot_product(a.x, b.x) + list_dot_product(b.x, b.x)"


def clusters_sql(rounds: int = 5) -> str:
    """Rounds of integer k-means, one after another: nearest centroid, then floors of means."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < 40)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, CAST(min(d * 64 + c) AS BIGINT) % 64 AS c, CAST(min(d) AS BIGINT) AS d FROM (SELECT a.r, b.c, {GAP} AS d FROM kept a, c{i} b) GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT c, list(m ORDER BY j) AS x FROM (
    SELECT c, j, floor(sum(e) / count(*)) AS m FROM (SELECT c, unnest(range(64)) AS j, unnest(x) AS e FROM kept JOIN a{i} USING (r)) GROUP BY c, j
  ) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(o.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} o USING (c)
"""


def codes_sql(rounds: int = 4) -> str:
    """Rounds of codebooks, one after another: nearest entry of each part, then floors of means."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p))""",
        "b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < 256) JOIN parts USING (r))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, CAST(min(d * 256 + e) AS BIGINT) % 256 AS e, CAST(min(d) AS BIGINT) AS d FROM (SELECT a.r, p, b.e, {GAP} AS d FROM parts a JOIN b{i} b USING (p)) GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT p, e, list(m ORDER BY j) AS x FROM (
    SELECT p, e, j, floor(sum(y) / count(*)) AS m FROM (SELECT p, e, unnest(range(len(x))) AS j, unnest(x) AS y FROM parts JOIN a{i} USING (r, p)) GROUP BY p, e, j
  ) GROUP BY p, e
), b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, o.x) AS x FROM b{i} o LEFT JOIN m{i} m USING (p, e))""")
    return f"""
WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books
"""


QUERIES = {f.__name__: f for f in (op1_hnsw_near_dup, op2_prefix_forest_ann, op3_mincut_main_text, op4_shard_placement, op5_context_mixing, op6_bpe_codec, op7_language_id, op8_simhash_near_dup, op9_sequence_packing, op10_secret_scan, op11_quality_gam, op12_ball_tree_clusters, op13_vector_codes)}
ORACLES: dict[str, str] = {"op1_hnsw_near_dup": NEAR_DUP_SQL, "op4_shard_placement": PLACEMENT_SQL, "op12_ball_tree_clusters": clusters_sql(), "op13_vector_codes": codes_sql()}
