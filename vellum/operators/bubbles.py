"""Bubbles round text, complete masks of text lines, and upright crops of tilted lines. Numpy inside tasks, over frames of many images."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from vellum.operators import contours as C, frames as F, quads as Q

#: Least area of a bubble and its largest share of the image; greys that a flood reaches over; padding asked for; height of a crop.
LEAST_AREA, LARGEST_SHARE, NEAR, PADDING, CROP_HEIGHT = 800, 0.3, 35, 12, 48
#: Least pixels of a component, share of overlap from which a line has it; sizes of dilation and margin over the text size.
SPECK, OVERLAP, DILATE, MARGIN = 9, 0.01, 0.3, 0.1


def blurred(grey: np.ndarray, w: np.ndarray | None = None, h: np.ndarray | None = None) -> np.ndarray:
    """Each pixel with its eight neighbours, weights 1 2 1 along both axes, rounded; the image is mirrored at its border.

    Of one image, or of frames (n, h, w) with images of ``w`` x ``h``.
    """
    if grey.ndim == 2:
        return blurred(grey.astype(np.int64)[None], np.array([grey.shape[1]]), np.array([grey.shape[0]]))[0]
    p = np.pad(grey, ((0, 0), (1, 1), (1, 1)))
    n = np.arange(len(grey))
    p[:, 0], p[n, h + 1] = p[:, min(2, grey.shape[1])], p[n, np.maximum(h - 1, 1)]
    p[h == 1, 0] = p[h == 1, 1]
    p[:, :, 0], p[n, :, w + 1] = p[:, :, min(2, grey.shape[2])], p[n, :, np.maximum(w - 1, 1)]
    p[w == 1, :, 0] = p[w == 1, :, 1]
    rows = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (rows[:, :, :-2] + 2 * rows[:, :, 1:-1] + rows[:, :, 2:] + 8) >> 4


def seeds(cx: np.ndarray, cy: np.ndarray, tw: np.ndarray, th: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the centre and four points a tenth of the smaller side away, 2 pixels at least, inside the image."""
    d = np.maximum(2, np.rint(np.minimum(tw, th) * 0.10).astype(np.int64))
    x, y = cx[:, None] + d[:, None] * [0, 1, -1, 0, 0], cy[:, None] + d[:, None] * [0, 0, 0, 1, -1]
    return np.clip(x, 0, w[:, None] - 1), np.clip(y, 0, h[:, None] - 1)


class Bubble(NamedTuple):
    x: int
    y: int
    w: int
    h: int
    confidence: float


def padding_of(flood: np.ndarray, chars: np.ndarray, tw: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The figure of :func:`vellum.functions.geometry.adaptive_padding`."""
    dim = np.maximum(1.0, np.sqrt(np.maximum(flood, 1)))
    dense = np.minimum(1.12, np.maximum(0.72, 1.06 - 0.16 * chars / dim))
    wanted = np.rint((0.45 * PADDING + 0.55 * 0.06 * dim) * dense).astype(np.int64)
    most = np.clip((np.minimum(tw, th) * 0.22).astype(np.int64), 3, 24)
    return np.maximum(3, np.minimum(most, wanted))


def confidence_of(flood: np.ndarray, area: np.ndarray, compact: np.ndarray, bw: np.ndarray, bh: np.ndarray, tw: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The figure of :func:`vellum.functions.geometry.bubble_confidence`."""
    unit = lambda v: np.clip(v, 0.0, 1.0)
    return 0.45 * unit((flood / np.maximum(area, 1) - 1) / 4) + 0.30 * unit(compact) + 0.25 * (unit(bw / np.maximum(tw, 1)) + unit(bh / np.maximum(th, 1))) / 2


def passes(flood: np.ndarray, area: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Whether a flooded area may be a bubble: neither small nor large, and more than the text's."""
    least = np.maximum(max(LEAST_AREA, 300), (area * 0.9).astype(np.int64))
    return (least <= flood) & (flood <= (image * LARGEST_SHARE).astype(np.int64)) & (flood >= area * 1.05)


def is_compact(flood: np.ndarray, compact: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Whether an area is compact enough for a text as dense."""
    least = np.maximum(0.28, np.minimum(0.42, 0.40 - 0.10 * chars / np.maximum(np.sqrt(np.maximum(flood, 1)), 1.0)))
    return (compact <= 0) | (compact >= least)


class Texts(NamedTuple):
    """Texts of images: place of the image, centre, size, characters, whether they run across."""

    image: np.ndarray
    cx: np.ndarray
    cy: np.ndarray
    w: np.ndarray
    h: np.ndarray
    chars: np.ndarray
    horizontal: np.ndarray


def bubble(grey: np.ndarray, cx: int, cy: int, tw: int, th: int, chars: int, horizontal: bool) -> Bubble | None:
    """The bubble of one text in a blurred image; see :func:`bubbles`."""
    h, w = grey.shape
    found, box, score = bubbles(grey[None], np.array([w]), np.array([h]), Texts(*(np.array([v]) for v in (0, cx, cy, tw, th, chars, horizontal))))
    return Bubble(*box[0].tolist(), float(score[0])) if len(found) else None


def bubbles(grey: np.ndarray, w: np.ndarray, h: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a bubble, the rectangles (x, y, w, h) to draw in, and their scores, in blurred frames (n, h, w) of images ``w`` x ``h``.

    A text has the best bubble round its centre among the floods of its seeds; the first of equal ones. Floods of
    as many images are found, followed and eroded together; seeds of an image with the same grey share what is near it.
    """
    none = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0)
    tw, th, area = texts.w, texts.h, np.maximum(1, texts.w * texts.h)
    x, y = seeds(texts.cx, texts.cy, tw, th, w[texts.image], h[texts.image])
    image = np.repeat(texts.image[:, None], 5, axis=1)
    shade = grey[image, y, x].astype(np.int64)
    low = int(shade.min(initial=0))
    span = int(shade.max(initial=0)) - low + 1
    key, level = np.unique(image * span + shade - low, return_inverse=True)
    level = level.reshape(image.shape)
    own, shades = key // span, key % span + low
    # what is flooded: pixels near the seed's grey that it reaches side by side
    far = np.int16(-20000) if grey.dtype == np.int16 else grey.min(initial=0) - 1_000_000  # less than any grey
    near = np.where(F.within(w, h, grey.shape), grey, far)[own] - (shades - NEAR).astype(grey.dtype)[:, None, None]
    runs = F.runs_of(near.view(f"u{near.itemsize}") <= 2 * NEAR, corners=False)
    root = runs.at(level, x, y)
    sizes = np.bincount(runs.least, weights=runs.high - runs.low, minlength=len(runs.least)).astype(np.int64)
    size = (w * h)[texts.image][:, None]
    text, seed = np.nonzero(passes(sizes[root], area[:, None], size))
    if not len(text):
        return none
    roots, flood = np.unique(root[text, seed], return_inverse=True)
    parts, order, of = runs.parts(roots)
    # each flood in a frame of its own, with one pixel more at each side
    left, top = parts.left - 1, parts.top - 1
    shape = (len(roots), int((parts.bottom - top).max()) + 2, int((parts.right - left).max()) + 2)
    row, start, end = runs.row[order] - top[of], runs.low[order] - left[of], runs.high[order] - left[of]
    masks = F.painted(of, row, start, end, shape)
    compact = compactness(masks, of, row, start, end)
    text_area, chars = area[text], texts.chars[text]
    kept = is_compact(parts.area[flood], compact[flood], chars)
    if not kept.any():
        return none
    text, seed, flood, text_area, chars = (v[kept] for v in (text, seed, flood, text_area, chars))
    own_w, own_h = tw[text], th[text]
    # eroded, by as much less as keeps the seed; what lies outside the image is no hole
    across, down = left[:, None] + np.arange(shape[2]), top[:, None] + np.arange(shape[1])
    place = own[parts.mask]
    solid = masks | ~(((down >= 0) & (down < h[place][:, None]))[:, :, None] & ((across >= 0) & (across < w[place][:, None]))[:, None, :])
    sx, sy = x[text, seed] - left[flood], y[text, seed] - top[flood]
    by = shrinking(solid, flood, sx, sy, padding_of(parts.area[flood], chars, own_w, own_h))
    most = int(by.max()) + 1
    kinds, kind = np.unique(flood * most + by, return_inverse=True)
    inner, reach = masks[kinds // most], kinds % most
    for p in np.unique(reach).tolist():
        some = reach == p
        inner[some] &= F.windowed(F.windowed(solid[kinds[some] // most], p, 1), p, 2) if p else True
    # of what is left, the part that has the seed
    runs = F.runs_of(inner, corners=True)
    roots, which = np.unique(runs.at(kind, sx, sy), return_inverse=True)
    pieces, order, of = runs.parts(roots)
    box_w, box_h = (pieces.right - pieces.left + 1)[which], (pieces.bottom - pieces.top + 1)[which]
    side = np.maximum(18, (np.minimum(own_w, own_h) * 0.55).astype(np.int64))
    fits = (box_w >= side) & (box_h >= side) & ~(texts.horizontal[text].astype(bool) & (box_w < own_w * 0.7))
    if not fits.any():
        return none
    score = np.full(x.shape, -np.inf)
    score[text[fits], seed[fits]] = confidence_of(parts.area[flood], text_area, compact[flood], box_w, box_h, own_w, own_h)[fits]
    found = np.flatnonzero(score.max(axis=1) > -np.inf)
    best = score[found].argmax(axis=1)
    at = np.zeros(x.shape, np.int64)
    at[text, seed] = np.arange(len(text))
    at = at[found, best]
    needed, again = np.unique(which[at], return_inverse=True)
    some = np.full(len(roots), -1)
    some[needed] = np.arange(len(needed))
    rows = some[of] >= 0
    order, of = order[rows], some[of[rows]]
    left_in, top_in = pieces.left[needed], pieces.top[needed]
    shape = (len(needed), int((pieces.bottom[needed] - top_in).max()) + 1, int((pieces.right[needed] - left_in).max()) + 1)
    rectangle = F.inscribed(F.painted(of, runs.row[order] - top_in[of], runs.low[order] - left_in[of], runs.high[order] - left_in[of], shape))[again]
    box = np.stack([pieces.left[which[at]], pieces.top[which[at]], box_w[at], box_h[at]], axis=1)
    rectangle[:, :2] += box[:, :2]
    drawn = drawn_in(box, rectangle)
    drawn[:, 0] += left[flood[at]]
    drawn[:, 1] += top[flood[at]]
    return found, drawn, np.clip(score[found, best], 0.0, 1.0)


def compactness(masks: np.ndarray, of: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Area within the outer border of each mask's one component over that of its hull, 0 where the hull has none; beside the masks their runs, by mask and row."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    areas = C.ring_areas(*C.rings_of(masks, np.arange(len(masks)), low[first], row[first], np.zeros(len(first), np.int64)))
    turns = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))  # first and last pixels of rows have the hull
    ends = np.append(turns[1:], len(of)) - 1
    whole = C.hull_areas(of[turns], row[turns], low[turns], high[ends] - 1, len(masks))
    return np.where(whole > 0, areas / np.where(whole > 0, whole, 1.0), 0.0)


def shrinking(solid: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, padding: np.ndarray) -> np.ndarray:
    """The most of ``padding``, two at a time less, with which no hole of its mask lies within as much of (x, y); 0 if that leaves less than 2."""
    n, h, w = solid.shape
    holes = np.zeros((n, h + 1, w + 1), np.int32)
    np.cumsum(np.cumsum(~solid, axis=1, dtype=np.int32), axis=2, out=holes[:, 1:, 1:])
    by, left = padding.copy(), np.arange(len(of))
    while len(left):
        p, k = by[left], of[left]
        low, high = np.maximum(x[left] - p, 0), np.minimum(x[left] + p + 1, w)
        top, bottom = np.maximum(y[left] - p, 0), np.minimum(y[left] + p + 1, h)
        left = left[holes[k, bottom, high] - holes[k, top, high] - holes[k, bottom, low] + holes[k, top, low] > 0]
        by[left] -= 2
        by[left[by[left] < 2]] = 0
        left = left[by[left] > 0]
    return by


def drawn_in(box: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The rule of :func:`vellum.operators.masks.policy`: the inner rectangles (x, y, w, h), a little inset, unless one loses too much of its box."""
    w, h = inner[:, 2], inner[:, 3]
    loses = (w <= 0) | (h <= 0) | (w * h < 0.45 * np.maximum(1, box[:, 2] * box[:, 3]))
    dx, dy = (np.clip(np.rint(s * 0.02).astype(np.int64), 2, 5) for s in (w, h))
    inset = inner + np.stack([dx, dy, -2 * dx, -2 * dy], axis=1)
    room = (inset[:, 2] >= 10) & (inset[:, 3] >= 10)
    return np.where(loses[:, None], box, np.where(room[:, None], inset, inner))


def clipped(ring: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a convex ring inside another."""
    x, y = by.T
    sign = 1.0 if x @ np.roll(y, -1) >= y @ np.roll(x, -1) else -1.0
    for a, b in zip(by, np.roll(by, -1, axis=0)):
        if not len(ring):
            break
        side = sign * ((b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0]))
        out = []
        for p, q, s, t in zip(ring, np.roll(ring, -1, axis=0), side, np.roll(side, -1)):
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append(p + s / (s - t) * (q - p))
        ring = np.array(out).reshape(-1, 2)
    return ring


def distance(point: np.ndarray, ring: np.ndarray) -> float:
    """Of a point from a convex ring, 0 inside."""
    edge, off = np.roll(ring, -1, axis=0) - ring, point - ring
    side = edge[:, 0] * off[:, 1] - edge[:, 1] * off[:, 0]
    if (side >= 0).all() or (side <= 0).all():
        return 0.0
    along = np.clip((off * edge).sum(axis=1) / np.maximum((edge * edge).sum(axis=1), 1e-12), 0, 1)
    return float(np.hypot(*(off - along[:, None] * edge).T).min())


def ellipse(size: int) -> list[int]:
    """Half widths of an elliptic kernel's rows, from its top."""
    r = size // 2
    return [round(r * math.sqrt((r * r - dy * dy) / (r * r))) for dy in range(-r, r + 1)] if r else [0]


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels within the elliptic kernel of a set one."""
    return F.dilated(mask[None], ellipse(size))[0]


def extended(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, width: np.ndarray, height: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, ...]:
    left, top = np.maximum(x - by, 0), np.maximum(y - by, 0)
    return left, top, np.minimum(w + 2 * by, width - left - 1), np.minimum(h + 2 * by, height - top - 1)


def lines_of(box: np.ndarray, area: np.ndarray, first: np.ndarray, count: np.ndarray, lines: np.ndarray, fonts: np.ndarray) -> np.ndarray:
    """The line that takes each component of ``box`` (x, y, w, h): what it overlaps most, if larger; with hardly any overlap the nearest, if near; else -1.

    A component looks at ``count`` lines from ``first`` on, one at least.
    """
    component = np.repeat(np.arange(len(box)), count)
    starts = np.cumsum(count) - count
    line = np.arange(len(component)) + np.repeat(first - starts, count)
    areas = Q.area(lines)
    x, y, w, h = box.astype(float).T
    square = np.stack([np.stack([x + dx * w, y + dy * h], axis=1) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))], axis=1)
    own = np.minimum(area[component], areas[line])
    shares = np.where(own > 0, Q.shared_areas(lines[line], square[component]) / np.where(own > 0, own, 1.0), 0.0)

    def best(v: np.ndarray) -> np.ndarray:
        """The first pair of each component with its least value."""
        return np.lexsort((v, component))[starts]

    most = best(-shares)
    overlaps = shares[most] > OVERLAP
    out = np.where((area < areas[line[most]]) & overlaps, line[most], -1)
    left = (area < areas[line[most]]) & ~overlaps
    pairs = np.flatnonzero(left[component])
    far = np.full(len(component), np.inf)
    far[pairs] = Q.point_gaps(np.stack([x + w / 2, y + h / 2], axis=1)[component[pairs]], lines[line[pairs]])
    near = best(far)
    within = left & (far[near] < 0.5 * np.maximum(np.minimum(fonts[line[near]], np.minimum(w, h)), 10))
    return np.where(within, line[near], out)


def complete_mask(mask: np.ndarray, lines: list[np.ndarray], fonts: list[float], offset: int = 0, last: int = 3) -> np.ndarray | None:
    """The mask of one image, None if no line takes anything; see :func:`complete_masks`."""
    height, width = mask.shape
    quads = np.array(lines, float).reshape(-1, 4, 2)
    out, found = complete_masks(mask[None], np.array([width]), np.array([height]), np.zeros(len(quads), np.int64), quads, np.array(fonts, float), offset, last)
    return out[0] if found[0] else None


def complete_masks(masks: np.ndarray, w: np.ndarray, h: np.ndarray, image: np.ndarray, lines: np.ndarray, fonts: np.ndarray, offset: int = 0, last: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Text masks (n, h, w) of images ``w`` x ``h`` cleaned up: components go to lines of their ``image`` (in order), each line's are dilated by its size, what no line takes is gone. And which images have a line that takes any.

    Lines' outlines part components first. A line's kernel is 0.3 of its text size,
    odd, 3 at least, and works within the line's own bounds.
    """
    masks, shape = masks & F.within(w, h, masks.shape), masks.shape
    low, high = lines.min(axis=1, initial=np.inf).astype(np.int64), lines.max(axis=1, initial=-np.inf).astype(np.int64)
    edge = np.stack([w[image], h[image]], axis=1)
    start, size = np.maximum(low, 0), np.maximum(np.minimum(high + 1, edge) - np.maximum(low, 0), 0)
    for side in (low, high):
        for axis in (0, 1):  # rows that an outline goes along, and columns
            across = 1 - axis
            some = np.flatnonzero((side[:, across] >= 0) & (side[:, across] < edge[:, across]))
            k = np.repeat(some, size[some, axis])
            along = start[k, axis] + np.arange(len(k)) - np.repeat(np.cumsum(size[some, axis]) - size[some, axis], size[some, axis])
            masks[(image[k], side[k, 1], along) if axis == 0 else (image[k], along, side[k, 0])] = False
    count = np.bincount(image, minlength=len(masks))
    runs = F.runs_of(masks, corners=True)
    parts, order, of = runs.parts()
    box = np.stack([parts.left, parts.top, parts.right - parts.left + 1, parts.bottom - parts.top + 1], axis=1)
    some = np.flatnonzero((parts.area > SPECK) & (count[parts.mask] > 0))
    taken = np.full(len(parts.root), -1)
    taken[some] = lines_of(box[some], parts.area[some], (np.cumsum(count) - count)[parts.mask[some]], count[parts.mask[some]], lines, fonts)
    found = np.zeros(len(masks), bool)
    out = np.zeros(shape, bool)
    some = np.flatnonzero(taken >= 0)
    if not len(some):
        return out, found
    found[parts.mask[some]] = True
    # what a line takes, and its bounds
    own, place = np.unique(taken[some], return_inverse=True)
    bounds = np.array([np.full(len(own), np.iinfo(np.int64).max)] * 2 + [np.zeros(len(own), np.int64)] * 2)
    for k, (f, v) in enumerate(((np.minimum, parts.left), (np.minimum, parts.top), (np.maximum, parts.right + 1), (np.maximum, parts.bottom + 1))):
        f.at(bounds[k], place, v[some])
    left, top, wide, tall = bounds[0], bounds[1], bounds[2] - bounds[0], bounds[3] - bounds[1]
    size = np.minimum(np.minimum(wide, tall), fonts[own])
    kernel = np.maximum(((size + offset) * DILATE).astype(np.int64) // 2 * 2 + 1, 3)
    width, height = w[image[own]], h[image[own]]
    left, top, wide, tall = extended(left, top, wide, tall, width, height, (size * MARGIN).astype(np.int64))
    seen = (wide > 0) & (tall > 0)
    left, top, wide, tall = extended(left, top, wide, tall, width, height, -(-kernel // 2))
    wide, tall = np.where(seen, wide, 0), np.where(seen, tall, 0)
    # each line's pixels in a frame of its own bounds
    line = np.full(len(parts.root), -1)
    line[some] = place
    kept = line[of] >= 0
    order, of = order[kept], line[of[kept]]
    row, first, end = runs.row[order] - top[of], np.maximum(runs.low[order] - left[of], 0), np.minimum(runs.high[order] - left[of], wide[of])
    kept = (row >= 0) & (row < tall[of]) & (first < end)
    of, row, first, end = (v[kept] for v in (of, row, first, end))
    frames = F.painted(of, row, first, end, (len(own), max(1, int(tall.max())), max(1, int(wide.max()))))
    for k in np.unique(kernel).tolist():
        frames[kernel == k] = F.dilated(frames[kernel == k], ellipse(k))
    frames &= F.within(wide, tall, frames.shape)
    of, y, x = np.nonzero(frames)
    out[image[own[of]], y + top[of], x + left[of]] = True
    return F.dilated(out, ellipse(last)) & F.within(w, h, shape), found


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective maps (..., 3, 3) that take four points (..., 4, 2) to four others: eight linear equations for each."""
    (x, y), (u, v) = (np.moveaxis(np.asarray(p, float), -1, 0) for p in (src, dst))
    one, none = np.ones(x.shape), np.zeros(x.shape)
    left = np.stack([np.stack([x, y, one, none, none, none, -u * x, -u * y], axis=-1), np.stack([none, none, none, x, y, one, -v * x, -v * y], axis=-1)], axis=-2)
    found = np.linalg.solve(left.reshape(*x.shape[:-1], 8, 8), np.stack([u, v], axis=-1).reshape(*x.shape[:-1], 8, 1))[..., 0]
    return np.concatenate([found, np.ones((*x.shape[:-1], 1))], axis=-1).reshape(*x.shape[:-1], 3, 3)


def sampled(parts: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, near: bool = False) -> np.ndarray:
    """Values between pixels of images (n, h, w), from the four round each place (n, rows, columns); 0 beyond an image's ``w`` and ``h``.

    ``near`` says that no place lies farther out than a pixel. ``x`` and ``y`` are used up.
    """
    n, tall, wide = parts.shape
    held = np.zeros((n, tall + 4, wide + 4))
    held[:, 2:-2, 2:-2] = np.where(F.within(w, h, parts.shape), parts, 0)
    lows = []
    for v, most in ((y, h), (x, w)):
        v *= 1e9
        np.rint(v, out=v)
        v /= 1e9
        lows.append(np.floor(v))
        v -= lows[-1]
        if not near:
            np.clip(lows[-1], -2, most[:, None, None], out=lows[-1])
    place, low = lows
    place *= wide + 4
    place += low
    place += (np.arange(n) * (tall + 4) * (wide + 4) + 2 * (wide + 4) + 2)[:, None, None]
    at, flat = place.astype(np.int64), held.ravel()
    taken = lambda by, out: np.take(flat[by:], at, out=out, mode="clip")
    upper, lower, other = taken(0, place), taken(wide + 4, low), taken(1, None)
    other -= upper
    other *= x
    upper += other
    taken(wide + 5, other)
    other -= lower
    other *= x
    lower += other
    lower -= upper
    lower *= y
    upper += lower
    return upper


#: Pixels of strips that are sampled at once.
SAMPLED = 1 << 15


def crop(grey: np.ndarray, quad: np.ndarray, horizontal: bool, size: int = CROP_HEIGHT) -> np.ndarray:
    """The strip of one tilted line; see :func:`crops`."""
    (_, strips), = crops(grey[None], np.array([grey.shape[1]]), np.array([grey.shape[0]]), np.zeros(1, np.int64), quad[None], np.array([horizontal]), size)
    return strips[0]


def crops(grey: np.ndarray, w: np.ndarray, h: np.ndarray, image: np.ndarray, quad: np.ndarray, horizontal: np.ndarray, size: int = CROP_HEIGHT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tilted lines of images ``w`` x ``h`` in frames (n, h, w) as upright strips of ``size`` rows, standing ones turned a quarter to the left.

    Gives the places of some quads with strips of one shape, and these strips. What lies outside a quad's bounds is 0.
    """
    quad = quad.astype(np.int64)
    middle = np.trunc((quad + np.roll(quad, -1, axis=1)) / 2)
    length = lambda a, b: np.sqrt(((middle[:, a] - middle[:, b]) ** 2).sum(axis=1))
    ratio = length(2, 0) / length(1, 3)
    edge = np.stack([w[image], h[image]], axis=1)
    low, high = np.clip(quad.min(axis=1), 0, edge), np.clip(quad.max(axis=1), 0, edge)
    tall, wide = (np.where(horizontal == flat, size, np.maximum(np.rint(v), 2)).astype(np.int64) for flat, v in ((True, size * ratio), (False, size / ratio)))
    tall, wide = np.maximum(tall, 2), np.maximum(wide, 2)
    corner = np.stack([np.zeros_like(tall), tall - 1], axis=1), np.stack([np.zeros_like(wide), wide - 1], axis=1)
    to = np.stack([corner[1][:, [0, 1, 1, 0]], corner[0][:, [0, 0, 1, 1]]], axis=2)
    back = homography(to, quad - low[:, None])
    even = np.abs(back[:, 2, 0]) * wide + np.abs(back[:, 2, 1]) * tall < 1e-13  # as of parallelograms: no place lies outside the quad
    whole = even & ((low == quad.min(axis=1)) & (high == quad.max(axis=1))).all(axis=1)
    kinds, kind = np.unique(np.stack([tall, wide, horizontal, even, whole]), axis=1, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(kind.ravel(), minlength=kinds.shape[1]))
    for (rows, columns, flat, affine, near), end, n in zip(kinds.T.tolist(), ends.tolist(), np.diff(ends, prepend=0).tolist()):
        some = max(1, SAMPLED // (rows * columns))
        for start in range(end - n, end, some):
            k = order[start : min(start + some, end)]
            own = high[k] - low[k]
            down, across = (np.arange(max(int(m), 1)) for m in own.max(axis=0)[::-1])
            y, x = np.minimum(low[k, 1, None] + down, grey.shape[1] - 1), np.minimum(low[k, 0, None] + across, grey.shape[2] - 1)
            parts = grey[image[k][:, None, None], y[:, :, None], x[:, None, :]]
            v, u = np.arange(rows)[None, :, None], np.arange(columns)[None, None, :]
            x, y, *z = ((back[k, j, 0, None, None] * u) + (back[k, j, 1, None, None] * v + back[k, j, 2, None, None]) for j in range(2 if affine else 3))
            strips = sampled(parts, *((x / z[0], y / z[0]) if z else (x, y)), own[:, 0], own[:, 1], bool(near))
            yield k, strips if flat else np.rot90(strips, axes=(1, 2))
