"""Every registered query against its SQL twin on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQLS:
        assert compare(df, con, SQLS[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
