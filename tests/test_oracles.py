"""Every query that SQL can express gives the SQL's rows, on the smallest tables."""

import pytest

from contentlake.plans import registry
from tests.oracle import connection, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, FOLDER).toPandas()
    if name in registry.oracle_sql():
        assert rows(found) == rows(con.execute(registry.oracle_sql()[name]).fetchdf())
    else:
        assert len(found.columns)


def test_queries_and_sql_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
