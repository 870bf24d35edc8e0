"""The queries that SQL can express give the SQL's rows on the smallest tables."""

from __future__ import annotations

import pytest

from tests.compare import connect, differences
from vellum.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF, connect(SF)) == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
