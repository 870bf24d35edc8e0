"""Whole pages in the task that numbered their lines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from vellum.operators.pages import over_pairs, page_pairs, whole_pages
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["J4_panels", "J3_component_match", "P11_components_kept"])
def test_pairs_of_a_page_are_neither_sorted_nor_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Window") <= 2  # one window, and its group limit if any


def test_pages_go_on_over_batches(spark):
    """A page of 9,000 lines between small ones comes whole and once."""
    rows = [(p, k) for p, n in ((1, 3), (2, 9000), (3, 1), (4, 5)) for k in range(n)]
    lines = spark.createDataFrame(rows, "page_id long, k long").withColumn("line_id", F.row_number().over(Window.partitionBy("page_id").orderBy("k")))
    each = lambda columns, starts: [columns[0][starts], np.diff(starts, append=len(columns[0])), np.add.reduceat(columns[1], starts)]
    got = sorted(map(tuple, whole_pages(lines.select("page_id", "line_id"), "page_id long, n long, total long", each).collect()))
    assert got == [(p, n, n * (n + 1) // 2) for p, n in ((1, 3), (2, 9000), (3, 1), (4, 5))]


def test_each_line_meets_all_lines_of_its_page():
    page = np.repeat([5, 6, 7, 9], [2, 1, 700, 2])
    starts = np.flatnonzero(np.diff(page, prepend=-1))
    seen = {(int(i), int(j)) for a, b in page_pairs(starts, len(page)) for i, row in zip(a, b) for j in row}
    assert seen == {(i, j) for i in range(len(page)) for j in range(len(page)) if page[i] == page[j]}
    assert max(b.size for _, b in page_pairs(starts, len(page))) <= 1 << 17
    assert over_pairs(starts, len(page), lambda a, b: (b.max(axis=1),))[0].tolist() == [1, 1, 2, *[702] * 700, 704, 704]
