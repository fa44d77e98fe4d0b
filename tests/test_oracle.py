"""Every registered query against its SQL oracle on the smallest test set."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in ORACLES])
def test_matches_oracle(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
