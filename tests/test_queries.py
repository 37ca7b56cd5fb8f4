"""Every query with SQL against DuckDB on the smallest tables; others run and have rows."""

import duckdb
import pytest

from meshloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, order):
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(catalog.ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == cols
    assert plain(df.collect(), [df.columns.index(c) for c in cols]) == plain(found.fetchall(), [theirs.index(c) for c in cols])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_plans_push_down(spark):
    plan = catalog.QUERIES["labels_merged"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
