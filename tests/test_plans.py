"""Every registered query against its SQL, on the smallest data set."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from voxfare.plans import catalog
from voxfare.plans.views import TABLES

SF = Path("/root/testdata/sf0.001")
ORACLES = driver.oracle_sql()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "none"
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.count() > 0 and "recommend_tier" in out.columns


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, str(SF))
    res = duck.execute(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in res.description], res.fetchall())


# The cross-validation of three full models takes minutes; tests/test_propensity.py runs it on a small forest.
PLAIN = sorted(set(catalog.queries()) - set(ORACLES) - {"model_cross_validation"})


@pytest.mark.parametrize("name", PLAIN)
def test_query_without_sql_runs(spark, name):
    df = driver.queries()[name](spark, str(SF))
    assert df.columns and df.count() > 0


def test_sizes_of_text_vectors_come_from_their_stored_values(spark, tmp_path):
    from voxfare.plans import catalog

    texts = ["apple banana apple", "apple cherry", None, "the"]
    spark.createDataFrame([(i, "en", x) for i, x in enumerate(texts) if x], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.queries()["text_vectors_tfidf"](spark, str(tmp_path))
    assert {r["doc_id"]: r["n_terms"] for r in out.collect()} == {0: 2, 1: 2, 3: 0}
    assert "unwrap_udt" in out._jdf.queryExecution().optimizedPlan().toString()  # no dense array of the vocabulary
