"""Every registered query against its DuckDB statement on whole tables at sf0.001."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
