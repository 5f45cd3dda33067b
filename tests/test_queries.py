"""Every registered query: against its SQL where there is one, else for rows and columns."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from scripts.check import TABLES, compare

DATA = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()
# Forest fits take long and have their own tests on small frames.
SLOW = {"random_forest", "fit_and_score", "seed_stability"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    yield db
    db.close()


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, connection, name):
    same, detail, _ = compare(spark, connection, name, QUERIES[name], SQL[name], DATA)
    assert same, detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["flex_windows", "pdu_training_table", "build_features", "sequence_windows"])
def test_plans_stay_on_built_in_operators(spark, name):
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
