"""The pipeline's stages on odd rows: nulls in any column, empty and long texts, ties, repeats, clashing names, empty tables."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_llm_operators import LONG, check_packing, docs

A, B = ("The cat of the house and the dog of the garden were at the door in the morning. " * 3, "Der Hund und die Katze sind in dem Haus an der Tür und warten auf den Morgen. " * 3)
ROWS = [(1, None, "en"), (2, "", None), (3, "½ ² ³ 123", "en"), (4, A, "en"), (5, A, "en"), (5, A, "en"), (None, A, None), (None, B, "de"), (6, B + "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "de"), (7, LONG, "en"), (8, B, None), (8, A + "other words", "en")] + [(i, (A, B)[i % 2] + f" word{i}", ("en", "de")[i % 2]) for i in range(20, 60)]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names clash with the operators' own."""
    return docs(spark, ROWS).withColumn("__parts", F.lit("p")).withColumn("score", F.lit(1)).withColumn("a.b", F.lit(2))


@pytest.fixture(scope="module")
def staged(spark, odd):
    out, now = {}, odd
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (now.collect(), stage(spark, now, ""))
        now = spark.createDataFrame(out[name][1].collect(), out[name][1].schema)
    return out


def test_language_takes_only_texts_with_letters(staged, odd):
    before, after = staged["language"]
    rows = after.collect()
    assert after.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in rows}
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) == 2


def test_near_dedup_keeps_a_row_of_each_group(staged, odd):
    before, after = staged["near_dedup"]
    rows = after.collect()
    assert after.columns == odd.columns and len(rows) == len({repr(tuple(r)) for r in rows}) <= len(before)
    assert sum(r.text == A for r in rows) == 1 and {repr(tuple(r)) for r in rows} <= {repr(tuple(r)) for r in before}


def test_secrets_change_values_alone(staged, odd):
    before, after = staged["secrets"]
    rows = after.collect()
    assert after.columns == odd.columns and len(rows) == len(before)
    changed = collections.Counter(map(tuple, rows)) - collections.Counter(map(tuple, before))
    assert all("[REDACTED]" in r[1] for r in changed) and not any("04dbebab91ab85687d33eeaaf9ac699e1188f962" in r.text for r in rows)


def test_packing_takes_every_row(staged):
    before, after = staged["packing"]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before])


@pytest.mark.parametrize("none", [True, False])
def test_run_on_a_folder(spark, odd, tmp_path, none):
    """The whole pipeline over an empty table, and over one whose texts are all null."""
    table = odd.drop("a.b").limit(0) if none else odd.drop("a.b").withColumn("text", F.lit(None).cast("string"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
