"""Every registered query with an SQL twin, on whole tables."""

import pytest
from conftest import SF
from oracle import compare, connect

from riskloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], con) == ""


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
