"""Every core query with SQL gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import oracle
import pytest

from driftloom.plans import queries

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    ours = oracle.rows_of_spark(queries.queries()[name](spark, FOLDER))
    theirs = oracle.rows_of_sql(connection, SQL[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_all_sql_names_are_queries():
    assert set(SQL) <= set(queries.queries())
