"""Every query with oracle SQL equals DuckDB on sf0.001 (rows, columns and an
order-insensitive value hash); every query runs."""

import pytest

import __spark_entry__ as se
from stratakit.plans import load_all
from tests.conftest import SF001
from tools.oracle_check import duck, table_hash

# The training-data queries have tests of their own.
SQL = {n: sql for n, sql in se.oracle_sql().items() if n in load_all()}
QUERIES = {n: q for n, q in se.queries().items() if n in load_all()}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert table_hash(df.columns, rows) == table_hash(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() >= 0


def test_entry(spark):
    df = se.entry(spark)
    assert df.count() > 0 and df.columns == ["segment", "n_pairs", "n_users", "response_rate"]
