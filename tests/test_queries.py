"""Every query with SQL agrees with it on the smallest tables."""

import pytest

from meshrel.plans import queries as algebra
from oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(algebra.ORACLES))
def test_query(spark, con, name):
    got = algebra.QUERIES[name](spark, FOLDER).toPandas()
    assert same(got, con.execute(algebra.ORACLES[name]).df()) == ""


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(algebra.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
