"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as contract
from bindery.plans.oracles import ORACLES
from bindery.plans.queries import QUERIES
from compare import connect, differences

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


def test_every_query_has_sql():
    assert set(ORACLES) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert differences(spark, con, name, "0.001") == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
