"""Borders of masks, hulls, least rectangles, and the boxes of a detector's score map. Numpy inside tasks, over frames of many images."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from vellum.operators import frames as F
from vellum.operators.masks import flooded, labelled

#: The eight neighbours clockwise from the west, as (dx, dy).
ROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))
#: Sides of a box in pixels before and after it is widened; borders looked at; how far an arc may lie from its circle.
LEAST_SIDE, LEAST_WIDENED, MOST_BORDERS, ARC = 3, 5, 1000, 0.25


def traced(mask: np.ndarray, x: int, y: int, empty: int, cells: bytes | None = None) -> np.ndarray:
    """The border through (x, y) as points (x, y), clockwise about its pixels from the unset neighbour ``empty`` (place in ROUND).

    ``cells`` are the mask's pixels of :func:`framed`, for several borders of a mask.
    """
    cells = framed(mask) if cells is None else cells
    wide = mask.shape[1] + 2
    steps = [dx + dy * wide for dx, dy in ROUND]
    start = x + 1 + (y + 1) * wide

    def step(at: int, e: int) -> tuple[int, int] | None:
        for k in range(1, 9):
            to = (e + k) % 8
            if cells[at + steps[to]]:
                return at + steps[to], _BACK[to]  # the last unset one, seen from the pixel we go to
        return None

    points, now = [start], step(start, empty)
    first = now
    while now is not None:
        after = step(*now)
        if now[0] == start and after[0] == first[0]:  # type: ignore[index]
            break
        points.append(now[0])
        now = after
    rows, columns = np.divmod(np.array(points), wide)
    return np.column_stack([columns - 1, rows - 1])


#: By the direction of a step, where the neighbour before it in ROUND is seen from the step's end.
_BACK = tuple(ROUND.index((ROUND[k - 1][0] - dx, ROUND[k - 1][1] - dy)) for k, (dx, dy) in enumerate(ROUND))


#: By the neighbours that are set (a bit for each place in ROUND) and the unset one looked from: the next set one clockwise, 8 without any.
_NEXT = np.array([[next(((e + k) % 8 for k in range(1, 9) if code >> (e + k) % 8 & 1), 8) for e in range(8)] for code in range(256)])


def rings_of(masks: np.ndarray, mask: np.ndarray, x: np.ndarray, y: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The borders of :func:`traced` through (x, y) of masks (n, h, w), all of them followed together: points (x, y) one border after another, and where each starts."""
    n, h, w = masks.shape
    wide = w + 2
    cells = np.zeros((n, h + 2, wide), np.uint8)
    cells[:, 1:-1, 1:-1] = masks
    cells = cells.ravel()
    steps = np.array([dx + dy * wide for dx, dy in ROUND] + [0])
    code = np.zeros(len(cells), np.uint8)
    for k, step in enumerate(steps[:8].tolist()):
        code[max(0, -step) : len(cells) - max(0, step)] |= cells[max(0, step) : len(cells) + min(0, step)] << k
    code = code.astype(np.int16) * 8
    start = (mask * (h + 2) + y + 1) * wide + x + 1
    back, next_ = np.array([*_BACK, 0]), _NEXT.ravel()
    size, seen = np.ones(len(start), np.int64), []
    to = next_[code[start] + empty]
    alive = np.flatnonzero(to < 8)  # a pixel by itself is its border
    to = to[alive]
    own = start[alive]
    at, e = own + steps[to], back[to]
    first = at
    while len(alive):
        to = next_[code[at] + e]
        after = at + steps[to]
        on = (at != own) | (after != first)
        if not on.all():
            alive, own, first, at, after, to = (v[on] for v in (alive, own, first, at, after, to))
        seen.append((alive, at))
        size[alive] += 1
        at, e = after, back[to]
    starts = np.cumsum(size) - size
    points = np.empty(int(size.sum()), np.int64)
    points[starts] = start
    for k, (who, where) in enumerate(seen, 1):
        points[starts[who] + k] = where
    line, column = np.divmod(points, wide)
    return np.stack([column - 1, line % (h + 2) - 1], axis=1), starts



def framed(mask: np.ndarray) -> bytes:
    """The mask's pixels row by row, in a frame of unset ones."""
    return np.pad(mask, 1).tobytes()


def holes(mask: np.ndarray) -> np.ndarray:
    """Unset pixels from which no way leads out of the image, side by side."""
    open_ = np.pad(~mask, 1, constant_values=True)
    return (open_ & ~flooded(open_, 0, 0))[1:-1, 1:-1]


def borders(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of the components (pixels that touch by side or corner) and borders of their holes, in the order of their first pixels."""
    found, cells = [], framed(mask)
    for x, y in firsts(labelled(mask)):
        found.append(((y, x, 0), traced(mask, x, y, 0, cells)))
    left = holes(mask)
    while left.any():
        y, x = divmod(int(left.ravel().argmax()), mask.shape[1])
        found.append(((y, x - 1, 1), traced(mask, x - 1, y, 4, cells)))  # what is west of a hole's first pixel is set
        left = left & ~flooded(left, x, y)
    return [points for _, points in sorted(found, key=lambda f: f[0])]


def firsts(label: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) of the first pixel of each component, numbered in that order."""
    flat = label.ravel()
    most = np.maximum.accumulate(flat)
    at = np.flatnonzero((flat > 0) & np.diff(most, prepend=0).astype(bool))
    return [(p % label.shape[1], p // label.shape[1]) for p in at.tolist()]


def area_of(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, float).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def ring_areas(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The figure of :func:`area_of` for rings one after another."""
    if not len(starts):
        return np.zeros(0)
    after = np.arange(1, len(points) + 1)
    after[np.append(starts[1:], len(points)) - 1] = starts
    x, y = points.T
    return np.abs(np.add.reduceat(x * y[after] - x[after] * y, starts)) / 2


def least_above(owner: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex line below the values of each owner; rows by owner and ``at``, each once.

    A value on or above the line between those beside it is no corner, so all such go at once, until none is left.
    """
    held = np.arange(len(owner))
    while len(held) > 2:
        a, b, c = held[:-2], held[1:-1], held[2:]
        over = (owner[a] == owner[c]) & ((value[b] - value[a]) * (at[c] - at[a]) >= (value[c] - value[a]) * (at[b] - at[a]))
        if not over.any():
            break
        held = np.delete(held, np.flatnonzero(over) + 1)
    return held


def hull_areas(owner: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Areas of the hulls of n sets of pixels, by the first and last pixel of each of their rows (sorted by owner and row)."""
    out = np.zeros(n)
    for ends in (low, -high):  # between the convex lines to the left and right
        k = least_above(owner, row, ends)
        same = owner[k[1:]] == owner[k[:-1]]
        a, b = k[:-1][same], k[1:][same]
        out -= np.bincount(owner[a], (ends[a] + ends[b]) * (row[b] - row[a]) / 2, minlength=n)
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise as y points up, without points on its edges."""
    every = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(every) < 3:
        return np.array(every)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (every, every[::-1]):
        chain: list[tuple] = []
        for p in order:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


class Rectangle(NamedTuple):
    corners: np.ndarray
    short: float
    long: float


def least_rectangle(points: np.ndarray) -> Rectangle:
    """The rectangle of least area round the points: one side lies along an edge of their hull. Of equal areas the first edge's."""
    ring = hull(points)
    edges = np.roll(ring, -1, axis=0) - ring
    length = np.hypot(*edges.T)
    if not length.any():
        return Rectangle(np.repeat(ring[:1], 4, axis=0), 0.0, 0.0)
    along = edges[length > 0] / length[length > 0][:, None]
    across = np.column_stack([-along[:, 1], along[:, 0]])
    u, v = along @ ring.T, across @ ring.T
    low_u, high_u, low_v, high_v = u.min(axis=1), u.max(axis=1), v.min(axis=1), v.max(axis=1)
    k = int(((high_u - low_u) * (high_v - low_v)).round(9).argmin())
    ends = [(low_u[k], low_v[k]), (high_u[k], low_v[k]), (high_u[k], high_v[k]), (low_u[k], high_v[k])]
    sides = sorted((float(high_u[k] - low_u[k]), float(high_v[k] - low_v[k])))
    return Rectangle(np.array([a * along[k] + b * across[k] for a, b in ends]), *sides)


def ordered(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: the two leftmost by height, then the two others."""
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = (p[np.argsort(p[:, 1], kind="stable")] for p in (by_x[:2], by_x[2:]))
    if by_x[1, 1] <= by_x[0, 1]:
        left = by_x[[1, 0]]
    if by_x[3, 1] <= by_x[2, 1]:
        right = by_x[[3, 2]]
    return np.array([left[0], right[0], right[1], left[1]])


def first_corners(corners: np.ndarray) -> np.ndarray:
    """The first of :func:`ordered` for many rectangles (n, 4, 2): of the two leftmost the upper one."""
    left = np.take_along_axis(corners, np.argsort(corners[..., 0], axis=1, kind="stable")[:, :2, None], axis=1)
    return np.where((left[:, 1, 1] <= left[:, 0, 1])[:, None], left[:, 1], left[:, 0])


def filled(ring: np.ndarray, w: int, h: int) -> np.ndarray:
    """Pixels of a w x h image on or inside a ring of whole-numbered points: line by line, between every other crossing."""
    inside = np.zeros((h, w), bool)
    x, y = np.asarray(ring, int).T
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    low, tall = np.minimum(y, y2), np.abs(y2 - y)
    edge = np.repeat(np.arange(len(x)), tall)  # an edge crosses each line from its upper end on, but for that of its lower end
    row = low[edge] + np.arange(len(edge)) - (np.cumsum(tall) - tall)[edge]
    at = x[edge] + (row - y[edge]) * (x2 - x)[edge] / (y2 - y)[edge]
    order = np.lexsort((at, row))
    row, at = row[order][::2], at[order]
    seen = (0 <= row) & (row < h)
    row, a, b = row[seen], np.ceil(at[::2][seen]).astype(int), np.floor(at[1::2][seen]).astype(int) + 1
    turns = np.zeros((h, w + 1), int)
    np.add.at(turns, (row, np.clip(a, 0, w)), 1)
    np.add.at(turns, (row, np.maximum(np.clip(b, 0, w), np.clip(a, 0, w))), -1)
    inside[:] = np.cumsum(turns, axis=1)[:, :w] > 0
    on = (0 <= x) & (x < w) & (0 <= y) & (y < h)  # a traced border's points are neighbours, so they are all of it
    inside[y[on], x[on]] = True
    return inside


def mean_inside(score: np.ndarray, ring: np.ndarray) -> float:
    """Mean score on and inside a border."""
    h, w = score.shape
    return float(score[filled(ring, w, h)].mean())


def widened(ring: np.ndarray, by: float) -> np.ndarray:
    """A convex ring moved outwards by ``by``, its corners rounded by arcs that keep within ARC of the circle."""
    ring = hull(ring)
    if len(ring) < 3:
        return ring
    edge = np.roll(ring, -1, axis=0) - ring
    out = np.arctan2(-edge[:, 0], edge[:, 1])  # of the outward normals
    step = 2 * np.arccos(max(0.0, 1 - ARC / by)) if by > 0 else np.pi
    points = []
    for k, corner in enumerate(ring):
        start = out[k - 1]
        sweep = (out[k] - start) % (2 * np.pi)
        n = max(1, int(np.ceil(sweep / step)))
        turn = start + sweep * np.arange(n + 1) / n
        points.append(corner + by * np.column_stack([np.cos(turn), np.sin(turn)]))
    return np.concatenate(points)


class Borders(NamedTuple):
    """Borders of masks, in the order of :func:`borders`: mask, points (x, y) one border after another and where each starts, length."""

    mask: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    size: np.ndarray


def borders_of(masks: np.ndarray) -> Borders:
    """:func:`borders` of many masks (n, h, w), unset beyond their images."""
    outer = F.runs_of(masks, corners=True)
    first = np.flatnonzero(outer.least == np.arange(len(outer.least)))
    open_ = F.runs_of(np.pad(~masks, ((0, 0), (1, 1), (1, 1)), constant_values=True), corners=False)
    hole = np.flatnonzero((open_.least == np.arange(len(open_.least))) & ((open_.row > 0) | (open_.low > 0)))
    # a hole's border goes through the set pixel west of its first one
    mask, y, x = (np.concatenate(v) for v in ((outer.mask[first], open_.mask[hole]), (outer.row[first], open_.row[hole] - 1), (outer.low[first], open_.low[hole] - 2)))
    empty = np.repeat([0, 4], [len(first), len(hole)])
    order = np.lexsort((empty, x, y, mask))
    points, starts = rings_of(masks, mask[order], x[order], y[order], empty[order])
    return Borders(mask[order], points, starts, np.diff(starts, append=len(points)))


def rectangles_of(of: Borders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners, short and long sides of the least rectangles of borders, as of :func:`least_rectangle`."""
    n = len(of.starts)
    corners, short, long = np.zeros((n, 4, 2)), np.zeros(n), np.zeros(n)
    if not n:
        return corners, short, long
    # the first and last point of each column of a border have its hull: below from the left, then above from the right
    owner = np.repeat(np.arange(n), of.size)
    x, y = of.points.T
    order = np.lexsort((y, x, owner))
    owner, x, y = owner[order], x[order], y[order]
    turns = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(x, prepend=x[0] - 1) != 0))
    ends = np.append(turns[1:], len(x)) - 1
    owner, x, low, high = owner[turns], x[turns], y[turns], y[ends]
    below, above = least_above(owner, x, low), least_above(owner, x, -high)
    above = above[::-1]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    alone = np.isin(above, np.concatenate([first, last])) & (low[above] == high[above])  # an end with one point is there already
    above = above[~alone]
    owner, side = np.concatenate([owner[below], owner[above]]), np.repeat([0, 1], [len(below), len(above)])
    ring = np.stack([np.concatenate([x[below], x[above]]), np.concatenate([low[below], high[above]])], axis=1).astype(float)
    order = np.lexsort((side, owner))
    ring, count = ring[order], np.bincount(owner, minlength=n)
    begins = np.cumsum(count) - count
    for size in np.unique(count).tolist():
        k = np.flatnonzero(count == size)
        corners[k], short[k], long[k] = _least_rectangles(ring[begins[k, None] + np.arange(size)])
    return corners, short, long


def _least_rectangles(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hulls (n, corners, 2)."""
    n, size, _ = rings.shape
    if size == 1:
        return np.repeat(rings, 4, axis=1), np.zeros(n), np.zeros(n)
    edges = np.roll(rings, -1, axis=1) - rings
    along = edges / np.hypot(edges[..., 0], edges[..., 1])[..., None]
    across = np.stack([-along[..., 1], along[..., 0]], axis=2)
    (low_u, high_u), (low_v, high_v) = ((v.min(axis=2), v.max(axis=2)) for v in (d @ rings.transpose(0, 2, 1) for d in (along, across)))
    at, k = np.arange(n), ((high_u - low_u) * (high_v - low_v)).round(9).argmin(axis=1)
    along, across, low_u, high_u, low_v, high_v = (v[at, k] for v in (along, across, low_u, high_u, low_v, high_v))
    corners = np.stack([u[:, None] * along + v[:, None] * across for u, v in ((low_u, low_v), (high_u, low_v), (high_u, high_v), (low_u, high_v))], axis=1)
    sides = np.sort(np.stack([high_u - low_u, high_v - low_v], axis=1), axis=1)
    return corners, sides[:, 0], sides[:, 1]


def means_of(scores: np.ndarray, of: Borders) -> np.ndarray:
    """Mean scores on and inside borders: the figure of :func:`mean_inside`."""
    n, h, w = scores.shape
    owner = np.repeat(np.arange(len(of.starts)), of.size)
    x, y = of.points.T
    after = np.arange(1, len(x) + 1)
    after[of.starts + of.size - 1] = of.starts
    # a border's points are neighbours: an edge crosses a line at its upper end, and every other crossing goes in
    upper = np.where(y[after] > y, x, x[after])
    sloped = np.flatnonzero(y != y[after])
    line, at = np.minimum(y, y[after])[sloped], upper[sloped]
    low = [np.minimum.reduceat(v, of.starts) if len(of.starts) else v for v in (x, y)]
    wide, tall = (np.maximum.reduceat(v, of.starts) - m + 2 if len(of.starts) else m for v, m in zip((x, y), low))  # one column more ends a row
    begins = np.cumsum(wide * tall) - wide * tall
    cells = int((wide * tall).sum())
    place = lambda k, x, y: begins[k] + (y - low[1][k]) * wide[k] + x - low[0][k]
    crossing = np.sort(place(owner[sloped], at, line))
    turns = np.bincount(crossing[::2], minlength=cells + 1) - np.bincount(crossing[1::2] + 1, minlength=cells + 1)
    inside = np.cumsum(turns)[:cells] > 0
    inside[place(owner, x, y)] = True
    cell = np.flatnonzero(inside)
    k = np.searchsorted(begins, cell, side="right") - 1
    row, column = np.divmod(cell - begins[k], wide[k])
    total = np.bincount(k, scores[of.mask[k], row + low[1][k], column + low[0][k]], minlength=len(begins))
    return total / np.bincount(k, minlength=len(begins))


def numbered(mask: np.ndarray) -> np.ndarray:
    """Numbers from 0 of rows of the same mask, which follow each other."""
    first = np.flatnonzero(np.diff(mask, prepend=-1))
    return np.arange(len(mask)) - np.repeat(first, np.diff(first, append=len(mask)))


def boxes(score: np.ndarray, threshold: float, least_score: float, ratio: float, to_w: int, to_h: int) -> list[tuple[float, np.ndarray]]:
    """(score, four corners) of what lies above the threshold in one map; see :func:`boxes_of`."""
    h, w = score.shape
    _, means, corners = boxes_of(score[None], *(np.array([v]) for v in (w, h)), threshold, least_score, ratio, *(np.array([v]) for v in (to_w, to_h)))
    return list(zip(means.tolist(), corners))


def boxes_of(scores: np.ndarray, w: np.ndarray, h: np.ndarray, threshold: float, least_score: float, ratio: float, to_w: np.ndarray, to_h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(map, score, four corners) of what lies above the threshold in score maps ``w`` x ``h``, in images of to_w x to_h.

    A border gives its least rectangle, which has to have a side of LEAST_SIDE and the
    mean score; widened by ``ratio`` times area over perimeter it needs LEAST_WIDENED.
    Corners start with that of the least x + y.
    """
    of = borders_of((scores > threshold) & F.within(w, h, scores.shape))
    rectangles, short, long = rectangles_of(of)
    means = means_of(scores, of)
    found = []
    for k in np.flatnonzero((numbered(of.mask) < MOST_BORDERS) & (short >= LEAST_SIDE) & (means >= least_score)).tolist():
        around = 2 * (short[k] + long[k])
        wide = least_rectangle(widened(rectangles[k], short[k] * long[k] * ratio / around))
        if wide.short < LEAST_WIDENED:
            continue
        m = of.mask[k]
        corners = ordered(wide.corners)
        corners = np.column_stack([np.clip(np.round(corners[:, j] / size[m] * to[m]), 0, to[m]) for j, size, to in ((0, w, to_w), (1, h, to_h))])
        corners = np.roll(corners, -int(corners.sum(axis=1).argmin()), axis=0)
        found.append((m, means[k], corners.astype(np.int64)))
    maps, best, corners = zip(*found) if found else ((), (), ())
    return np.array(maps, np.int64), np.array(best, float), np.array(corners, np.int64).reshape(-1, 4, 2)
