"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from siteplan_spark.plans.registry import QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_entry_has_rows(spark):
    assert not entry_module.entry(spark).isEmpty()
