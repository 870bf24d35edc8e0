"""Masks of pages united as lines come in."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from vellum.operators.masks import over_pages
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["A16_mask_union", "G28_inscribed_rectangles", "G29_drawing_rectangles"])
def test_no_cell_is_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_pages_go_on_over_batches(spark):
    """A page of 9,000 lines between small ones: each page once, its cells as a plain set has them."""
    r = np.random.Generator(np.random.PCG64(2))
    rows = [(p, *(int(v) for v in r.integers((0, 0, 1, 1), (90, 90, 40, 40)))) for p, n in ((1, 3), (2, 9000), (3, 1), (4, 5)) for _ in range(n)]
    lines = spark.createDataFrame(rows, "page_id long, x long, y long, w long, h long")
    lines = lines.withColumn("line_id", F.row_number().over(Window.partitionBy("page_id").orderBy("x", "y", "w", "h")).cast("long"))
    each = lambda pages, starts, px, py, bits: [pages, np.diff(starts, append=len(px)), np.add.reduceat(bits, starts)]
    got = {b.page_id: (b.area, b.total) for b in over_pages(lines, "page_id long, area long, total long", each).collect()}
    want: dict = {}
    for b in lines.collect():
        held = want.setdefault(b.page_id, {})
        for px in range(b.x // 5, (b.x + b.w - 1) // 5 + 1):
            for py in range(b.y // 5, (b.y + b.h - 1) // 5 + 1):
                held[px, py] = held.get((px, py), 0) | 1 << (b.line_id - 1) % 16
    assert got == {p: (len(c), sum(c.values())) for p, c in want.items()}
