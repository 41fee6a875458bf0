"""Every registered query with SQL equals DuckDB on the smallest data set."""

import os

import pytest

import __spark_entry__
from workload.compare import compare, connect
from workload.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    equal, message = compare(spark, con, FOLDER, name)
    assert equal, message
