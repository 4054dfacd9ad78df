"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("SEAGRID_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, connection, name):
    result = check.compare(spark, connection, FOLDER, name, oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    zones = entry(spark)
    assert zones.count() > 0 and "rank" in zones.columns
