"""Trees of many components at once against one at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np

from vellum.operators import regions as R


def test_weights_equal_one_tree_at_a_time():
    r = np.random.Generator(np.random.PCG64(5))
    for size in (1, 2, 3, 9):
        x, y, w, h = (r.integers(1, 60, (200, size)).astype(float) for _ in range(4))
        got = R.tree_weights(x, y, w, h)
        for k in range(200):
            away = lambda p, q: np.maximum(np.maximum(p[None] - (p + q)[:, None], p[:, None] - (p + q)[None]), 0)
            want = R._tree(list(range(size)), np.hypot(away(x[k], w[k]), away(y[k], h[k])))
            assert got[k].tolist() == [e[0] for e in want]


def test_a_large_component_needs_no_table_of_all_pairs():
    """3,000 boxes: a table of all their distances alone is 72 MB."""
    x, y = (v.astype(float)[None] for v in np.divmod(np.arange(3000), 50))
    tracemalloc.start()
    assert R.tree_weights(x * 10, y * 10, x * 0 + 7, x * 0 + 7).tolist() == [[3.0] * 2999]
    assert tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()
