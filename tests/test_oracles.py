"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


# the text operators have tests of their own, which go with them
OWN = {n for n, fn in QUERIES.items() if fn.__module__ == "__spark_entry__"}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(name, spark, duck):
    difference, _ = compare(QUERIES[name](spark, SMALL), duck, SQL[name])
    assert difference is None, difference


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["stock_code", "week", "idx", "units"]
    assert df.count() > 0
