"""Every catalog query against its SQL twin, on the smallest tables."""

import os

import pytest

from catalog import ORACLE_SQL, QUERIES

from .check_catalog import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name]) is None


def test_forest_query_flags_its_share(spark):
    df = QUERIES["c10_isolation_forest"](spark, FOLDER)
    share = df.where("is_outlier").count() / df.count()
    assert 0.04 < share <= 0.051


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 1
    assert set(oracle_sql()) <= set(queries())
