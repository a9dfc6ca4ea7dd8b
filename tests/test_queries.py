"""Graph queries against their DuckDB statements on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from facetflow import queries
from oracle import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    assert compare(spark, connection(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
