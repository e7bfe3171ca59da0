"""Every query with SQL gives DuckDB's rows; the others run with a stable schema."""

import pytest

from brightloom.plans import intake, serving  # noqa: F401  each registers its queries
from brightloom.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import duck, same


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
