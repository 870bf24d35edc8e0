"""Grid joins against all pairs of a page, and a page that holds a third of all lines."""

from __future__ import annotations

import numpy as np

from vellum.functions.geometry import can_merge, iou
from vellum.operators import regions as R

LINES = "page_id long, line_id long, x long, y long, w long, h long"


def boxes(n: int, across: int, page: int, seed: int) -> list[tuple]:
    r = np.random.Generator(np.random.PCG64(seed))
    x, y, w, h = r.integers(-across, across, n), r.integers(0, across, n), r.integers(1, 60, n), r.integers(1, 60, n)
    w[: n // 20] *= 20
    return [(page, k, int(x[k]), int(y[k]), int(w[k]), int(h[k])) for k in range(n)]


def test_near_pairs_equal_all_pairs(spark):
    rows = boxes(200, 300, 1, 1) + boxes(150, 2000, 2, 2) + [(3, 0, 0, 0, 512, 512), (3, 1, 256, 256, 256, 1), (3, 2, 511, 511, 9, 9)]
    lines = spark.createDataFrame(rows, LINES)
    for tolerances in (R.MERGE, R.DIRECTION):
        want = {(p.page_id, p.a_line_id, p.b_line_id) for p in R.page_pairs(lines).where(can_merge("a", "b", **tolerances)).collect()}
        got = [(p.page_id, p.src, p.dst) for p in R.merge_pairs(lines, tolerances).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    for cell in (16, 256):
        want = {(p.page_id, p.a_line_id, p.b_line_id) for p in R.page_pairs(lines).where(iou("a", "b") > 0).collect()}
        got = [(p.page_id, p.a_line_id, p.b_line_id) for p in R.near_pairs(lines, cell=cell).where(iou("a", "b") > 0).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_page_with_most_lines_goes_by_its_cells(spark):
    """20,000 lines on one page: 200 million pairs, of which the cells look at a few."""
    rows = boxes(20_000, 40_000, 1, 3) + boxes(300, 300, 2, 4)
    lines = spark.createDataFrame(rows, LINES)
    assert R.near_pairs(lines, 1.0).count() < 2_000_000
    assert R.merge_pairs(lines).count() > 50
