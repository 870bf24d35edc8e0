"""Bubbles, completed masks and crops against plain loops over pixels."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from vellum.operators import bubbles as B, contours as C, masks as M
from vellum.queries import QUERIES
from vellum.queries.bubbles import centre, pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    rows = pages(spark, SF).orderBy("image_id").limit(24).collect()
    return [(r.image_id, np.array(r.grey).reshape(r.h, r.w), [x.asDict() for x in r.regions]) for r in rows]


def plain_blur(grey: np.ndarray) -> np.ndarray:
    h, w = grey.shape
    at = lambda v, n: -v if v < 0 else 2 * (n - 1) - v if v >= n else v
    out = np.zeros_like(grey)
    for y, x in itertools.product(range(h), range(w)):
        total = sum((2 - abs(dy)) * (2 - abs(dx)) * int(grey[at(y + dy, h), at(x + dx, w)]) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[y, x] = (total + 8) // 16
    return out


def plain_flood(grey: np.ndarray, x: int, y: int) -> set:
    h, w = grey.shape
    seen, line = {(x, y)}, [(x, y)]
    while line:
        a, b = line.pop()
        for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
            if 0 <= p < w and 0 <= q < h and (p, q) not in seen and abs(int(grey[q, p]) - int(grey[y, x])) <= 35:
                seen.add((p, q))
                line.append((p, q))
    return seen


def plain_bubble(grey: np.ndarray, r: dict) -> tuple | None:
    h, w = grey.shape
    (cx, cy), tw, th, chars = centre(r), r["w"], r["h"], r["chars"]
    d = max(2, round(min(tw, th) * 0.1))
    points: list = []
    for a, b in ((cx, cy), (cx + d, cy), (cx - d, cy), (cx, cy + d), (cx, cy - d)):
        p = (max(0, min(a, w - 1)), max(0, min(b, h - 1)))
        if p not in points:
            points.append(p)
    best = None
    for sx, sy in points:
        flood = plain_flood(grey, sx, sy)
        n, text = len(flood), tw * th
        if n < max(800, int(text * 0.9), 300) or n > int(w * h * 0.3) or n < text * 1.05:
            continue
        mask = np.zeros((h, w), bool)
        for a, b in flood:
            mask[b, a] = True
        ring = max(C.borders(mask), key=C.area_of)
        compact = C.area_of(ring) / C.area_of(C.hull(ring))
        if 0 < compact < max(0.28, min(0.42, 0.40 - 0.10 * chars / math.sqrt(n))):
            continue
        dim = math.sqrt(n)
        pad = max(3, min(24, max(3, int(min(tw, th) * 0.22)), round((0.45 * 12 + 0.55 * 0.06 * dim) * max(0.72, min(1.12, 1.06 - 0.16 * chars / dim)))))
        inner = mask
        for p in range(pad, 1, -2):
            kept = {(a, b) for a, b in flood if all(not (0 <= a + i < w and 0 <= b + j < h) or (a + i, b + j) in flood for i in range(-p, p + 1) for j in range(-p, p + 1))}
            if (sx, sy) in kept:
                inner = np.zeros((h, w), bool)
                for a, b in kept:
                    inner[b, a] = True
                break
        part, line = {(sx, sy)}, [(sx, sy)]
        while line:
            a, b = line.pop()
            for i, j in itertools.product((-1, 0, 1), repeat=2):
                q = (a + i, b + j)
                if 0 <= q[0] < w and 0 <= q[1] < h and inner[q[1], q[0]] and q not in part:
                    part.add(q)
                    line.append(q)
        xs, ys = [p[0] for p in part], [p[1] for p in part]
        box = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
        side = max(18, int(min(tw, th) * 0.55))
        if box[2] < side or box[3] < side or (tw >= th and box[2] < tw * 0.7):
            continue
        unit = lambda v: max(0.0, min(1.0, v))
        score = 0.45 * unit((n / text - 1) / 4) + 0.30 * unit(compact) + 0.25 * (0.5 * unit(box[2] / tw) + 0.5 * unit(box[3] / th))
        if best is None or score > best[0]:
            best = (score, part, box)
    if best is None:
        return None
    score, part, box = best
    mask = np.zeros((h, w), bool)
    for a, b in part:
        mask[b, a] = True
    x, y, bw, bh = M.inscribed_rectangle(mask)
    if bw * bh < 0.45 * box[2] * box[3]:
        return (*box, score)
    dx, dy = max(2, min(5, round(bw * 0.02))), max(2, min(5, round(bh * 0.02)))
    return (x + dx, y + dy, bw - 2 * dx, bh - 2 * dy, score) if bw - 2 * dx >= 10 and bh - 2 * dy >= 10 else (x, y, bw, bh, score)


def test_blur_equals_plain_loop(some):
    for _, grey, _ in some[:4]:
        assert (B.blurred(grey) == plain_blur(grey)).all()


def test_bubbles_equal_plain_python(some):
    found = 0
    for _, grey, own in some:
        soft = B.blurred(grey)
        for r in own:
            got, want = B.bubble(soft, *centre(r), r["w"], r["h"], r["chars"], r["w"] >= r["h"]), plain_bubble(soft, r)
            assert (got is None) == (want is None)
            if got is not None:
                found += 1
                assert tuple(got[:4]) == want[:4] and got.confidence == pytest.approx(want[4])
    assert found > 20


def plain_dilated(mask: np.ndarray, size: int) -> np.ndarray:
    h, w = mask.shape
    r = size // 2
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        for dy in range(-r, r + 1):
            half = round(r * math.sqrt((r * r - dy * dy) / (r * r)))
            for dx in range(-half, half + 1):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    out[y + dy, x + dx] = True
    return out


def plain_mask(mask: np.ndarray, lines: list, fonts: list) -> np.ndarray | None:
    h, w = mask.shape
    mask = mask.copy()
    for q in lines:
        x, y, x2, y2 = int(q[:, 0].min()), int(q[:, 1].min()), int(q[:, 0].max()), int(q[:, 1].max())
        for b, a in itertools.product(range(h), range(w)):
            if x <= a <= x2 and y <= b <= y2 and (a in (x, x2) or b in (y, y2)):
                mask[b, a] = False
    own: dict = {}
    left = {(int(a), int(b)) for b, a in zip(*np.nonzero(mask))}
    while left:
        start = min(left, key=lambda p: (p[1], p[0]))
        part, line = set(), [start]
        while line:
            p = line.pop()
            if p in left:
                left.remove(p)
                part.add(p)
                line += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if len(part) <= 9:
            continue
        x, y = min(p[0] for p in part), min(p[1] for p in part)
        bw, bh = max(p[0] for p in part) - x + 1, max(p[1] for p in part) - y + 1
        square = np.array([[x, y], [x + bw, y], [x + bw, y + bh], [x, y + bh]], float)
        areas = [C.area_of(q) for q in lines]
        shares = [(C.area_of(c) if len(c := B.clipped(q, square)) > 2 else 0) / min(len(part), a) for q, a in zip(lines, areas)]
        k = shares.index(max(shares))
        if len(part) >= areas[k]:
            continue
        if shares[k] <= 0.01:
            far = [B.distance(np.array([x + bw / 2, y + bh / 2]), q) for q in lines]
            k = far.index(min(far))
            if far[k] >= 0.5 * max(min(fonts[k], bw, bh), 10):
                continue
        own.setdefault(k, set()).update(part)
    if not own:
        return None
    out = np.zeros_like(mask)
    for k, part in own.items():
        x, y = min(p[0] for p in part), min(p[1] for p in part)
        bw, bh = max(p[0] for p in part) - x + 1, max(p[1] for p in part) - y + 1
        size = min(bw, bh, fonts[k])
        box = (x, y, bw, bh)
        for by in (int(size * 0.1), (max(int(size * 0.3) // 2 * 2 + 1, 3) + 1) // 2):
            a, b = max(box[0] - by, 0), max(box[1] - by, 0)
            box = (a, b, min(box[2] + 2 * by, w - a - 1), min(box[3] + 2 * by, h - b - 1))
        here = np.zeros_like(mask)
        for p in part:
            here[p[1], p[0]] = True
        a, b, c, d = box
        out[b : b + d, a : a + c] |= plain_dilated(here[b : b + d, a : a + c], max(int(size * 0.3) // 2 * 2 + 1, 3))
    return plain_dilated(out, 3)


def test_completed_masks_equal_plain_loops(some):
    r = np.random.Generator(np.random.PCG64(2))
    cases = [((grey > 200) & (r.random(grey.shape) < 0.6), [np.array(x["q"], float).reshape(4, 2) for x in own]) for _, grey, own in some]
    cases += [(r.random((40, 50)) < 0.25, [r.integers(0, 36, 2) + np.array([[0, 0], [14, 3], [13, 9], [-1, 6]], float) for _ in range(3)]) for _ in range(12)]
    kept = 0
    for mask, quads in cases:
        fonts = [float(r.integers(4, 30)) for _ in quads]
        got, want = B.complete_mask(mask, quads, fonts), plain_mask(mask, quads, fonts)
        assert (got is None) == (want is None)
        if got is not None:
            kept += 1
            assert (got == want).all()
    assert kept > 20
    assert B.complete_mask(np.ones((5, 5), bool), [], []) is None


def test_dilation_equals_plain_loop():
    r = np.random.Generator(np.random.PCG64(3))
    for size in (3, 5, 7, 11):
        mask = r.random((17, 13)) < 0.05
        assert (B.dilated(mask, size) == plain_dilated(mask, size)).all()


def test_crops():
    r = np.random.Generator(np.random.PCG64(4))
    grey = r.integers(0, 256, (120, 200))
    upright = np.array([[20, 10], [120, 10], [120, 57], [20, 57]])
    strip = B.crop(grey, upright, True)
    assert strip.shape[0] == 48
    wide = strip.shape[1]
    for k in range(48):  # rows go over to rows, places between pixels to what lies between
        for u in (0, 1, wide // 2, wide - 2):
            x = u * 100 / (wide - 1)
            a = int(x)
            want = grey[10 + k, 20 + a] * (1 - x + a) + (grey[10 + k, 21 + a] * (x - a) if a + 1 < 100 else 0)
            assert k == 47 or strip[k, u] == pytest.approx(want)  # the last row lies on the bound, which the crop leaves out
    standing = B.crop(grey, np.array([[20, 10], [67, 10], [67, 110], [20, 110]]), False)
    assert standing.shape[0] == 48
    tilted = np.array([[30, 20], [110, 35], [105, 70], [25, 52]])
    got = B.crop(grey, tilted, True)
    to = np.array([[0, 0], [got.shape[1] - 1, 0], [got.shape[1] - 1, 47], [0, 47]])
    there = B.homography(tilted - tilted.min(axis=0), to)
    part = grey[20:70, 25:110]
    for v, u in ((0, 0), (10, 17), (30, 60), (47, got.shape[1] - 1), (25, 3)):
        x, y, z = np.linalg.inv(there) @ (u, v, 1)
        x, y = round(x / z, 9), round(y / z, 9)
        want = 0.0
        for a, b in itertools.product((math.floor(x), math.floor(x) + 1), (math.floor(y), math.floor(y) + 1)):
            if 0 <= a < part.shape[1] and 0 <= b < part.shape[0]:
                want += part[b, a] * (1 - abs(x - a)) * (1 - abs(y - b))
        assert got[v, u] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name", ["K1_crops", "K4_single_bubble", "K5_bubbles", "K7_complete_mask"])
def test_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 20
