"""Regions of tilted lines against plain Python."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from vellum.operators import bubbles as B, regions as R
from vellum.queries.tilted import tilted, tilted_merge_pairs, tilted_regions

SF = "/root/testdata/sf0.001"


def gap(a: np.ndarray, b: np.ndarray) -> float:
    """0 where the rings share a point, else the least distance of a corner from the other ring."""
    if len(B.clipped(a, b)):
        return 0.0
    return min(*(B.distance(p, b) for p in a), *(B.distance(p, a) for p in b))


def split(lines: list[int], quad: dict, font: dict, angle: dict) -> list[frozenset]:
    if len(lines) == 1:
        return [frozenset(lines)]
    if len(lines) == 2:
        u, v = lines
        near = gap(quad[u], quad[v]) < 1.5 * max(font[u], font[v]) and abs(angle[u] - angle[v]) < 0.2 * math.pi
        return [frozenset(lines)] if near else [frozenset([u]), frozenset([v])]
    inside, edges = {lines[0]}, []
    while len(inside) < len(lines):  # Prim's tree; weights are told apart by the lines
        d, u, v = min((gap(quad[u], quad[v]), min(u, v), max(u, v)) for u in inside for v in lines if v not in inside)
        edges.append((d, u, v))
        inside |= {u, v}
    edges.sort(key=lambda e: (-e[0], e[1], e[2]))
    far = [e[0] for e in edges]
    mean, sigma, fonts = np.mean(far), np.std(far), np.mean([font[k] for k in lines])
    d, u, v = edges[0]
    middle = lambda k: quad[k].mean(axis=0)
    if (d <= mean + 2 * sigma or d <= 1.5 * fonts) and (sigma < max(0.3 * fonts + 5, 5) or (gap(quad[u], quad[v]) == 0 and min(abs(middle(u) - middle(v))) < 5)):
        return [frozenset(lines)]
    group = {k: {k} for k in lines}
    for _, a, b in edges[1:]:
        both = group[a] | group[b]
        for k in both:
            group[k] = both
    return [p for part in {frozenset(g) for g in group.values()} for p in split(sorted(part), quad, font, angle)]


def test_regions_equal_plain_python(spark):
    rows = tilted(spark, SF).where("page_id < 1200").collect()
    pages: dict = collections.defaultdict(dict)
    for r in rows:
        pages[r.page_id][r.line_id] = (np.array([(q.x, q.y) for q in r.p]), r.font, r.angle)
    pairs = collections.defaultdict(list)
    for r in tilted_merge_pairs(spark, SF).where("page_id < 1200").collect():
        pairs[r.page_id].append((r.src, r.dst))
    got: dict = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in tilted_regions(spark, SF).where("page_id < 1200").collect():
        got[r.page_id][r.region_id].add(r.line_id)
    several = 0
    for page, lines in pages.items():
        group = {k: {k} for k in lines}
        for u, v in pairs[page]:
            both = group[u] | group[v]
            for k in both:
                group[k] = both
        quad, font, angle = ({k: v[n] for k, v in lines.items()} for n in range(3))
        want = {p for part in {frozenset(g) for g in group.values()} for p in split(sorted(part), quad, font, angle)}
        assert {frozenset(v) for v in got[page].values()} == want
        several += any(len(p) > 1 for p in want)
    assert several > 10


def test_ring_gaps_equal_plain_distances():
    r = np.random.Generator(np.random.PCG64(1))
    rings = []
    while len(rings) < 12:
        x, y, w, h, t = r.uniform(0, 60), r.uniform(0, 60), r.uniform(2, 25), r.uniform(2, 25), r.uniform(0, 3)
        corners = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
        rings.append(corners @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + (x, y))
    got = R.ring_gaps(np.array(rings))
    for i in range(12):
        for j in range(12):
            assert got[i, j] == pytest.approx(0.0 if i == j else gap(rings[i], rings[j]), abs=1e-9)
