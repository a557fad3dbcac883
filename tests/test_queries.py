"""Every registered query against its SQL."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
