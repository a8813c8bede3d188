"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {k: v for f in entry_point.FAMILIES for k, v in f.QUERIES.items()}
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    difference = oracle.differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert difference is None, difference


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 500 * 64
