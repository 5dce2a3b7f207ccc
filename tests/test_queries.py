"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from mediaframe.plans import REGISTRY
from tests.oracle_check import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
# inputs SQL cannot see: files on disk
ROWS_ONLY = {"source_binary_scan"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert {n for n, q in REGISTRY.items() if q.sql is None} == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    if q.sql is None:
        assert q.build(spark, SF).count() > 0
        return
    result = compare(q.build(spark, SF), con, q.sql)
    assert result.startswith("ok"), result


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
