"""Many images at once against one at a time, and against plain loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from vellum.operators import bubbles as B, contours as C, frames as F, masks as M
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["G35_borders", "K1_crops", "K4_single_bubble", "K5_bubbles", "K7_complete_mask", "K15_contour_boxes"])
def test_pixels_stay_in_the_task_that_draws_them(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "grey" not in plan


def noisy(r: np.random.Generator, n: int = 3) -> np.ndarray:
    return r.random((n, 12, 14)) < r.choice([0.2, 0.5, 0.8])


def test_components_rings_and_hulls_of_many_masks():
    r = np.random.Generator(np.random.PCG64(11))
    for _ in range(60):
        masks = noisy(r)
        runs = F.runs_of(masks, corners=True)
        parts, order, of = runs.parts()
        points, starts = C.rings_of(masks, parts.mask, runs.low[parts.root], parts.top, np.zeros(len(parts.root), np.int64))
        rings, areas = np.split(points, starts[1:]), C.ring_areas(points, starts)
        alone = [(mask, label) for mask in masks for label in [M.labelled(mask)]]
        firsts = [(mask, x, y) for mask, label in alone for x, y in C.firsts(label)]
        assert len(rings) == len(firsts)
        for ring, area, (mask, x, y) in zip(rings, areas, firsts):
            want = C.traced(mask, x, y, 0)
            assert ring.tolist() == want.tolist() and area == C.area_of(want)
        assert list(zip(*(v.tolist() for v in (parts.area, parts.left, parts.top, parts.right - parts.left + 1, parts.bottom - parts.top + 1)))) == [e for _, label in alone for e in M.extents(label)]
        apart = F.painted(of, runs.row[order], runs.low[order], runs.high[order], (len(rings), 12, 14))
        assert apart.sum() == masks.sum()
        hulls = [C.hull(ring) for ring in rings]
        whole = [C.area_of(h) if len(h) > 2 else 0.0 for h in hulls]
        assert B.compactness(apart, of, runs.row[order], runs.low[order], runs.high[order]).tolist() == [a / b if b else 0.0 for a, b in zip(areas, whole)]
        assert F.inscribed(apart).tolist() == [list(M.inscribed_rectangle(m)) for m in apart]
        assert F.inscribed(masks).tolist() == [list(M.inscribed_rectangle(m)) for m in masks]


def test_windows_of_many_masks():
    r = np.random.Generator(np.random.PCG64(12))
    for reach in range(6):
        masks = r.random((2, 12, 14)) < 0.9
        got = F.windowed(F.windowed(masks, reach, 1), reach, 2)
        for (k, y, x), inside in np.ndenumerate(got):
            assert inside == masks[k, max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1].all()


def test_bubbles_of_many_images_equal_those_of_each():
    """Images of several sizes in frames as large as the largest, blots in them that reach the border or not, texts inside and beside."""
    r = np.random.Generator(np.random.PCG64(13))
    w, h = r.integers(50, 90, 40), r.integers(50, 80, 40)
    grey, texts, alone = np.zeros((40, h.max(), w.max()), np.int16), [], []
    for k in range(40):
        y, x = np.mgrid[: h[k], : w[k]]
        cx, cy = int(r.integers(15, 60)), int(r.integers(12, 45))
        own = np.where(((x - cx) / r.integers(16, 22)) ** 2 + ((y - cy) / r.integers(16, 20)) ** 2 < 1, 220, 70) + r.integers(0, 20, (h[k], w[k]))
        grey[k, : h[k], : w[k]] = own
        for _ in range(r.integers(0, 4)):
            texts.append((k, cx + int(r.integers(-12, 13)), cy + int(r.integers(-12, 13)), int(r.integers(8, 26)), int(r.integers(6, 20)), int(r.integers(0, 40)), bool(r.integers(0, 2))))
            alone.append(B.bubble(B.blurred(own), *texts[-1][1:]))
    soft = B.blurred(grey, w, h)
    found, box, score = B.bubbles(soft, w, h, B.Texts(*map(np.array, zip(*texts))))
    assert found.tolist() == [k for k, b in enumerate(alone) if b is not None] and 10 < len(found) < len(texts)
    assert [(*b, s) for b, s in zip(box.tolist(), score.tolist())] == [tuple(b) for b in alone if b is not None]
    assert len(B.bubbles(soft, w, h, B.Texts(*np.zeros((7, 0), np.int64)))[0]) == 0


def test_crops_of_many_quads_equal_those_of_each():
    """Quads at angles, some beyond the image, some that are no parallelograms, in images of several sizes."""
    r = np.random.Generator(np.random.PCG64(14))
    w, h = r.integers(30, 60, 12), r.integers(30, 50, 12)
    grey = np.zeros((12, h.max(), w.max()), np.int64)
    for k in range(12):
        grey[k, : h[k], : w[k]] = r.integers(1, 256, (h[k], w[k]))
    image = np.sort(r.integers(0, 12, 40))
    quad = r.integers(-6, 40, (40, 1, 2)) + np.where(r.random((40, 1, 1)) < 0.5, [[0, 0], [18, 3], [17, 12], [-1, 9]], [[0, 0], [9, -2], [9, 20], [0, 22]])
    quad[::4] += r.integers(-2, 3, (10, 4, 2))
    across = r.random(40) < 0.5
    seen = {}
    for at, strips in B.crops(grey, w, h, image, quad, across):
        seen |= dict(zip(at.tolist(), strips))
    assert sorted(seen) == list(range(40)) and sum(s.any() for s in seen.values()) > 25
    for k in range(40):
        own = B.crop(grey[image[k], : h[image[k]], : w[image[k]]], quad[k], across[k])
        assert seen[k].shape == own.shape and (seen[k] == own).all() and own.shape[0] == 48
    turned = B.homography(quad, quad + [3, 4])
    assert np.allclose(turned, [[1, 0, 3], [0, 1, 4], [0, 0, 1]], atol=1e-9)


def test_completed_masks_of_many_images_equal_those_of_each():
    """Images of several sizes, some without lines, lines that go over the right and lower border."""
    r = np.random.Generator(np.random.PCG64(15))
    w, h, count = r.integers(20, 60, 30), r.integers(20, 50, 30), r.integers(0, 4, 30)
    masks = np.zeros((30, h.max(), w.max()), bool)
    for k in range(30):
        masks[k, : h[k], : w[k]] = r.random((h[k], w[k])) < r.choice([0.15, 0.3])
    image = np.repeat(np.arange(30), count)
    quads = r.integers(0, 45, (len(image), 1, 2)) + np.array([[0, 0], [14, 3], [13, 9], [-1, 6]], float) * r.choice([1, 2], (len(image), 1, 1))
    fonts = r.integers(4, 40, len(image)).astype(float)
    got, found = B.complete_masks(masks, w, h, image, quads, fonts)
    for k in range(30):
        own = B.complete_mask(masks[k, : h[k], : w[k]], list(quads[image == k]), fonts[image == k].tolist())
        assert found[k] == (own is not None)
        assert got[k].sum() == (0 if own is None else own.sum()) and (own is None or (got[k, : h[k], : w[k]] == own).all())
    assert 10 < found.sum() < 30


def test_borders_of_many_maps_equal_those_of_each():
    """Their order, points, least rectangles, first corners and means, in maps of several sizes."""
    r = np.random.Generator(np.random.PCG64(16))
    for _ in range(40):
        w, h = r.integers(1, 15, 4), r.integers(1, 13, 4)
        scores = np.full((4, h.max(), w.max()), 0)
        for k in range(4):
            scores[k, : h[k], : w[k]] = r.integers(0, 256, (h[k], w[k]))
        masks = (scores > r.choice([60, 120, 200])) & F.within(w, h, scores.shape)
        of = C.borders_of(masks)
        rings, (corners, short, long), means = np.split(of.points, of.starts[1:]), C.rectangles_of(of), C.means_of(scores, of)
        alone = [(k, ring) for k in range(4) for ring in C.borders(masks[k, : h[k], : w[k]])]
        assert of.mask.tolist() == [k for k, _ in alone] and [x.tolist() for x in rings] == [x.tolist() for _, x in alone]
        for j, (k, ring) in enumerate(alone):
            box = C.least_rectangle(ring)
            assert (short[j], long[j]) == pytest.approx((box.short, box.long)) and corners[j] == pytest.approx(box.corners)
            assert C.first_corners(corners)[j].tolist() == C.ordered(corners[j])[0].tolist()
            assert means[j] == C.mean_inside(scores[k, : h[k], : w[k]], ring)
    assert len(C.borders_of(np.zeros((2, 3, 3), bool)).mask) == len(C.means_of(np.zeros((2, 3, 3)), C.borders_of(np.zeros((2, 3, 3), bool)))) == 0
    found = C.boxes_of(np.zeros((1, 5, 5)), *np.full((2, 1), 5), 1, 1, 2.2, *np.full((2, 1), 9))
    assert [len(v) for v in found] == [0, 0, 0]


def test_images_of_any_size_have_frames_of_like_sizes():
    """A wide image and a high one don't widen the frames of others; nothing is lost."""
    sizes = [(3, 2), (4000, 1), (5, 4), (1, 3000), (7, 7), (8, 8), (900, 900)]
    batch = pa.RecordBatch.from_pydict({"image_id": list(range(7)), "w": [w for w, _ in sizes], "h": [h for _, h in sizes], "grey": [list(range(w * h)) for w, h in sizes]})
    seen = {}
    for s in F.stacks(batch, [], None):
        assert s.grey.size <= sum(int(w * h) + 7 * int(w + h) + 49 for w, h in zip(s.w, s.h))
        for k, name in enumerate(s.image_id.tolist()):
            seen[name] = s.grey[k, : s.h[k], : s.w[k]].ravel().tolist()
    assert seen == {k: list(range(w * h)) for k, (w, h) in enumerate(sizes)}
