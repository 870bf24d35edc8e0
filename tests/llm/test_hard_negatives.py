"""Hard negatives against all inner products in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vellum.llm import hard_negatives as H
from vellum.sources.tables import read_table

ROWS = "vec_id bigint, embedding array<float>, label int, score int, block string"


def plain(rows: list[tuple]) -> list[tuple]:
    held: dict[int, tuple] = {}
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(c))))) for c in x]
        row = ((label + 1) % 10 if i % 7 == 0 else label, v)
        held[i] = min(held.get(i, row), row)
    product = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (label, v) in held.items():
        if a % 100:
            continue
        every = sorted((-product(v, w), i, other) for i, (other, w) in held.items() if i != a)
        for s, p, _ in [x for x in every if x[2] == label][:5]:
            fits = [x for x in every if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


def edge_rows() -> list[tuple]:
    r = np.random.Generator(np.random.PCG64(11))
    rows = [(i, [float(x) for x in r.normal(0, 1, 6)], int(r.integers(0, 4)), 1, "b") for i in range(700)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0, 0.0, 0.125], int(i % 3), None, None) for i in range(400)]  # ties, of several labels
    rows += [(2000, [1.0, 2.0], 1, 1, "b"), (2001, [], 1, 1, "b"), (2002, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 2, 1, "b"), (2100, [0.0] * 6, 3, 1, "b"), (-100, [1.0] * 6, 2, 1, "b"), (-7, [1.0] * 6, -1, 1, "b")]
    rows += [(None, [1.0] * 6, 1, 1, "b"), (3000, None, 1, 1, "b"), (3100, [1.0, None], 1, 1, "b"), (3200, [1.0] * 6, None, 1, "b"), (3300, [math.nan] * 6, 1, 1, "b"), (3400, [math.inf] * 6, 1, 1, "b")]
    return rows + rows[:3] + [(5, [9.0] * 6, 0, 1, "b")]


@pytest.mark.parametrize("small", [False, True])
def test_rows_equal_all_inner_products(spark, monkeypatch, small):
    """With small blocks many block pairs and both prunings are at work."""
    if small:
        for name, n in (("BLOCK", 64), ("LEAF", 8), ("CELL", 32), ("BUNDLE", 2)):
            monkeypatch.setattr(H, name, n)
    rows = edge_rows()
    got = H.hard_negatives(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_empty_tables_and_no_anchors(spark):
    empty = spark.createDataFrame([], ROWS)
    assert H.hard_negatives(empty).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 1, 1, "b")], ROWS)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(100, [1.0], 1, 1, "b")], ROWS)).count() == 0


def test_search_prunes_clusters_and_finds_the_same():
    """Clusters far apart: most leaf pairs go by their intervals, and nothing that counts does."""
    r = np.random.Generator(np.random.PCG64(3))
    centres = r.normal(0, 400, (20, 8))
    v = np.floor(centres[np.arange(8000) % 20] + r.normal(0, 8, (8000, 8))).astype(np.int32)
    t = H.tree(v.astype(float))
    side = H.Side(np.arange(8000)[t.order], np.zeros(8000, np.int32), v[t.order], t)
    asked = np.arange(0, 8000, 100)
    scored = []
    exact = H.scores
    H.scores = lambda a, b: scored.append(len(a) * len(b)) or exact(a, b)
    try:
        k, ids, score = H.dual_search(side, side, asked, np.full(80, H._LEAST_SCORE), np.full(80, -H._LEAST_SCORE), True)
    finally:
        H.scores = exact
    assert sum(scored) < 0.5 * 80 * 8000
    every = side.v.astype(np.int64) @ side.v[asked].astype(np.int64).T
    for n, a in enumerate(asked):
        order = np.lexsort((side.ids, -every[:, n]))
        order = order[order != a][:5]
        assert list(ids[k == n]) == list(side.ids[order]) and list(score[k == n]) == list(every[order, n])


def test_intervals_hold_all_products():
    r = np.random.Generator(np.random.PCG64(4))
    for _ in range(50):
        a, b = (np.floor(r.normal(r.normal(0, 50, 5), r.uniform(1, 60), (40, 5))) for _ in range(2))
        ca, cb = a.mean(axis=0), b.mean(axis=0)
        lo, hi = H.intervals(ca, np.sqrt(((a - ca) ** 2).sum(axis=1).max()), cb, np.sqrt(((b - cb) ** 2).sum(axis=1).max()))
        every = a @ b.T
        assert lo <= every.min() and every.max() <= hi


def test_recall_is_whole_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in read_table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    got = H.hard_negatives(read_table(spark, "/root/testdata/sf0.01", "embeddings")).collect()
    assert sorted(map(tuple, got)) == plain(rows)
