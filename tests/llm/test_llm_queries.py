"""Registered queries against their SQL, and the registry itself."""

import pytest

import __spark_entry__ as contract
from bindery.llm import oracles, queries
from compare import connect, differences


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(oracles.ORACLES) < set(queries.QUERIES) < set(contract.queries())
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, name, "0.001") == []
