"""Every query that has SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import pytest

from tests.compare import connect, differences
from vellum.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, con, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF, con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
