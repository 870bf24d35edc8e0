"""Borders, least rectangles, fills, hulls, clipping and offsets against plain versions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from vellum.functions import polygons as P
from vellum.operators import contours as C
from vellum.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def masks() -> list[np.ndarray]:
    r = np.random.Generator(np.random.PCG64(5))
    out = [r.random((int(r.integers(1, 12)), int(r.integers(1, 14)))) < p for p in (0.3, 0.5, 0.6, 0.75, 0.9) for _ in range(30)]
    return out + [np.zeros((4, 5), bool), np.ones((5, 4), bool), np.ones((1, 1), bool), np.pad(np.zeros((3, 3), bool), 1, constant_values=True)]


def regions(mask: np.ndarray, corners: bool) -> list[set]:
    """Components of set pixels by plain search."""
    todo, out = set(zip(*(a.tolist() for a in np.nonzero(mask)))), []
    while todo:
        part, line = set(), [min(todo)]
        while line:
            y, x = line.pop()
            if (y, x) in todo:
                todo.remove((y, x))
                part.add((y, x))
                line += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (corners or a == 0 or b == 0)]
        out.append(part)
    return out


def test_borders_are_the_pixels_beside_what_is_outside_or_in_a_hole():
    for mask in masks():
        want = []
        h, w = mask.shape
        open_ = regions(np.pad(~mask, 1, constant_values=True), corners=False)
        for part in regions(mask, corners=True):
            for empty in open_:
                beside = {(y, x) for y, x in part if any((y + 1 + a, x + 1 + b) in empty for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
                holds = (0, 0) in empty
                around = {(y - 1 + a, x - 1 + b) for y, x in empty for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))}
                if beside and (holds or min(empty)[0] - 1 >= 0 and (min(empty)[0] - 1, min(empty)[1] - 2) in part and around):
                    want.append(beside)
        got = [{(int(y), int(x)) for x, y in ring} for ring in C.borders(mask)]
        assert sorted(map(sorted, got)) == sorted(map(sorted, want))
        for ring in C.borders(mask):
            step = np.abs(np.roll(ring, -1, axis=0) - ring).max(axis=1)
            assert len(ring) == 1 or (step == 1).all()


def test_least_rectangles_equal_a_search_over_all_directions():
    r = np.random.Generator(np.random.PCG64(6))
    for n in (1, 2, 3, 4, 7, 20):
        for _ in range(20):
            points = r.integers(0, 12, (n, 2))
            box = C.least_rectangle(points)
            best = min((np.ptp(points @ u) * np.ptp(points @ v) for a, b in itertools.permutations(points.tolist(), 2) if a != b for u in [(np.array(b) - a) / math.dist(a, b)] for v in [np.array([-u[1], u[0]])]), default=0.0)
            assert box.short * box.long == pytest.approx(best, abs=1e-9)
            ring = C.ordered(box.corners)
            assert C.area_of(ring) == pytest.approx(best, abs=1e-9)
            for a, b in zip(ring, np.roll(ring, -1, axis=0)):  # all points on one side
                assert ((b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) > -1e-6).all()


def test_fills_equal_a_test_of_each_pixel():
    r = np.random.Generator(np.random.PCG64(7))
    for _ in range(60):
        mask = np.pad(r.random((7, 9)) < 0.6, 1)
        for ring in C.borders(mask):
            own = {(int(y), int(x)) for x, y in ring}
            pairs = list(zip(ring.tolist(), np.roll(ring, -1, axis=0).tolist()))
            for y, x in itertools.product(range(9), range(11)):
                inside = sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in pairs) % 2 == 1
                assert C.filled(ring, 11, 9)[y, x] == (inside or (y, x) in own)


def test_widened_rings_have_the_area_of_a_rounded_offset():
    r = np.random.Generator(np.random.PCG64(8))
    for _ in range(30):
        ring = C.hull(r.integers(0, 60, (9, 2)))
        by = float(r.uniform(0.5, 20))
        around = np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum()
        want = C.area_of(ring) + around * by + math.pi * by * by
        got = C.area_of(C.widened(ring, by))
        assert want - 2 * math.pi * by * C.ARC <= got <= want + 1e-6


def test_boxes_of_a_known_map():
    score = np.zeros((40, 60), int)
    score[10:16, 20:40] = 200
    score[30:32, 5:50] = 200  # too thin
    score[20:28, 10:30] = 120  # too faint
    ((mean, box),) = C.boxes(score, 100, 150, 2.2, 60, 40)
    by = 19 * 5 * 2.2 / 48
    assert mean == 200 and box.tolist() == np.round([[20 - by, 10 - by], [39 + by, 10 - by], [39 + by, 15 + by], [20 - by, 15 + by]]).astype(int).tolist()


def rings(n: int) -> list[tuple[list, list]]:
    r = np.random.Generator(np.random.PCG64(9))
    out = []
    while len(out) < n:
        a, b = (C.hull(r.integers(0, 30, (5, 2)) + r.integers(0, 12)) for _ in range(2))
        if len(a) > 2 and len(b) > 2:
            out.append((a.tolist(), b.tolist()[:: -1 if len(out) % 2 else 1]))
    out += [([[0, 0], [4, 0], [4, 4], [0, 4]],) * 2, ([[0, 0], [4, 0], [4, 4], [0, 4]], [[4, 0], [8, 0], [8, 4], [4, 4]]), ([[0, 0], [9, 0], [9, 9], [0, 9]], [[2, 2], [3, 2], [3, 3]])]
    return out


def common(a: list, b: list) -> float:
    """Area of the hull of all corners of one inside the other and all places where edges meet."""
    def inside(p: tuple, ring: list) -> bool:
        side = [(q[0] - o[0]) * (p[1] - o[1]) - (q[1] - o[1]) * (p[0] - o[0]) for o, q in zip(ring, ring[1:] + ring[:1])]
        return min(side) >= -1e-9 or max(side) <= 1e-9

    points = [p for p in a if inside(p, b)] + [p for p in b if inside(p, a)]
    for (p, q), (s, t) in itertools.product(zip(a, a[1:] + a[:1]), zip(b, b[1:] + b[:1])):
        d = (q[0] - p[0]) * (t[1] - s[1]) - (q[1] - p[1]) * (t[0] - s[0])
        if d:
            u = ((s[0] - p[0]) * (t[1] - s[1]) - (s[1] - p[1]) * (t[0] - s[0])) / d
            v = ((s[0] - p[0]) * (q[1] - p[1]) - (s[1] - p[1]) * (q[0] - p[0])) / d
            if 0 <= u <= 1 and 0 <= v <= 1:
                points.append([p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])])
    ring = C.hull(np.round(np.array(points), 9)) if points else np.empty((0, 2))
    return C.area_of(ring) if len(ring) > 2 else 0.0


def test_clipping_and_hulls_as_columns(spark):
    kind = "array<struct<x:double,y:double>>"
    every = [(k, [tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b]) for k, (a, b) in enumerate(rings(120))]
    df = spark.createDataFrame(every, f"k int, a {kind}, b {kind}")
    for r in df.select("k", P.shared_area(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(common(*([list(p) for p in x] for x in every[r.k][1:])), abs=1e-6)
    r = np.random.Generator(np.random.PCG64(10))
    clouds = [(k, [tuple(map(float, p)) for p in r.integers(0, 8, (n, 2))]) for k, n in enumerate([1, 2, 3, 4, 8, 25] * 12)]
    for row in spark.createDataFrame(clouds, f"k int, p {kind}").select("k", P.hull(F.col("p")).alias("h")).collect():
        assert sorted(map(tuple, row.h)) == sorted(map(tuple, C.hull(np.array(clouds[row.k][1])).tolist()))


@pytest.mark.parametrize("name", ["K15_contour_boxes", "P6_candidate_boxes", "G35_borders"])
def test_map_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 20


@pytest.mark.parametrize("name", ["G34_offset_polygon", "G9_tilted_area", "G12_hull", "J3_tilted_match", "P11_tilted_kept"])
def test_rows_equal_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF, connect(SF)) == ""
