"""A corpus pipeline over ``documents``: language ID, SimHash near-dedup, secret scans, packing.

Each stage takes any table with doc_id, text and lang, and whatever other columns: they are passed on as they are, by any name. An empty table gives an
empty one of the same columns. Rows aren't told apart by doc_id alone, so null and repeated ids lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm import bytecnn, packing, secret_scan, simhash
from meshloom.llm.common import table
from meshloom.llm.queries import vocabulary
from meshloom.plans.ship import ship
from meshloom.plans.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without letters (null and empty texts too), and those that no language fits, go.

    Long texts are read whole. Rows with a null lang are judged like others, and aren't learnt from; with no labelled row at all nothing can be told, and all go. Repeated rows stay or go together.
    """
    ship(spark)
    return bytecnn.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest id, nulls last, ties by a hash of all columns; rows that are equal in all columns give one.

    Null and empty texts are one group. The stage follows op 8's rule: 3-word shingles, fingerprints at most 3 bits apart.
    """
    ship(spark)
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with the values of secrets replaced; null and empty texts and all other characters stay as they are."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens. A null or empty text is its end mark alone; repeated rows have pieces each."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", pack)]

#: Learnt models and tokenizers decide, which SQL doesn't express; the tests hold it against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
