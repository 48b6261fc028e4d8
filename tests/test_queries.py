"""Every core query against its SQL, on whole tables."""

import os

import pytest

from corpusloom.plans import registry
from tests.compare import connect, spark_rows, sql_rows
from tests.conftest import SMALL

SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(registry.queries()[name](spark, SMALL)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"resource_id", "stage"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
