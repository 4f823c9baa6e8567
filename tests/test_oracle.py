"""Every registered query against its SQL oracle on the shared test tables."""

import os

import pytest

import __spark_entry__ as entry_point
from tests.comparing import differences, oracle_connection

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
ORACLES = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    without = {name for name in QUERIES if name not in ORACLES}
    assert {name for name in without if not name.startswith("op") and name != "pipeline"} == set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, oracle, name):
    assert differences(QUERIES[name](spark, FOLDER), oracle, ORACLES[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1
