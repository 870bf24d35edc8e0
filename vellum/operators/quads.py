"""Figures of convex quads, many rows at once: numpy inside tasks, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are worked on at once.
ROWS = 4096


def with_figures(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop``, with those of ``schema``, which ``each`` works out of some rows."""
    kept = [c for c in df.columns if c not in drop]
    added = StructType.fromDDL(schema)
    arrow = to_arrow_schema(added)
    names = [*kept, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [pa.array(v, f.type) for v, f in zip(each(batch), arrow)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=names)

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + added.fields))


def rings(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Corners (rows, 4, 2) of a column of quads."""
    flat = batch.column(name).flatten()
    return np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).reshape(batch.num_rows, 4, 2)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def area(ring: np.ndarray) -> np.ndarray:
    """Of rings (rows, corners, 2) in either direction; corners may repeat."""
    x, y = ring[..., 0], ring[..., 1]
    return np.abs((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)) / 2


def _span(normal: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    along = ring[:, None, :, 0] * normal[:, :, None, 0] + ring[:, None, :, 1] * normal[:, :, None, 1]
    return along.min(axis=2), along.max(axis=2)


def _least_square(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """The least square distance of a point from an edge of the ring."""
    edge = np.roll(ring, -1, axis=1) - ring
    dx, dy = edge[:, None, :, 0], edge[:, None, :, 1]
    ex, ey = (points[:, :, None, k] - ring[:, None, :, k] for k in (0, 1))
    along = np.clip((ex * dx + ey * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0.0, 1.0)
    ox, oy = ex - along * dx, ey - along * dy
    return (ox * ox + oy * oy).min(axis=(1, 2))


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of quads p[k] and q[k]: 0 where they meet or one holds the other. The figure of :func:`vellum.functions.geometry.quad_gap`."""
    apart = np.zeros(len(p), bool)
    for ring in (p, q):
        edge = np.roll(ring, -1, axis=1) - ring
        normal = np.stack([-edge[..., 1], edge[..., 0]], axis=-1)
        (low_p, high_p), (low_q, high_q) = _span(normal, p), _span(normal, q)
        apart |= ((high_p < low_q) | (high_q < low_p)).any(axis=1)
    out = np.zeros(len(p))
    if apart.any():
        p, q = p[apart], q[apart]
        out[apart] = np.sqrt(np.minimum(_least_square(p, q), _least_square(q, p)))
    return out


def point_gaps(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distances of points (rows, 2) from convex rings, 0 inside."""
    edge, off = np.roll(ring, -1, axis=1) - ring, points[:, None] - ring
    side = edge[..., 0] * off[..., 1] - edge[..., 1] * off[..., 0]
    inside = (side.min(axis=1) >= 0) | (side.max(axis=1) <= 0)
    return np.where(inside, 0.0, np.sqrt(_least_square(points[:, None], ring)))


def shared_areas(p: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Areas that quads p[k] and by[k] have in common: each p is cut along the edges of its ``by``, as :func:`vellum.functions.polygons.clipped` does."""
    low, high = np.maximum(p.min(axis=1), by.min(axis=1)), np.minimum(p.max(axis=1), by.max(axis=1))
    out, meets = np.zeros(len(p)), (low < high).all(axis=1)
    if not meets.any():
        return out
    ring, by = p[meets], by[meets]
    x, y = by[..., 0], by[..., 1]
    back = (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) < 0
    by = np.where(back[:, None, None], by[:, ::-1], by)
    count = np.full(len(ring), 4)
    for k in range(by.shape[1]):
        a, b = by[:, k, None], by[:, (k + 1) % by.shape[1], None]
        n = ring.shape[1]
        at = np.arange(n)
        real = at < count[:, None]
        after = np.where(at + 1 < count[:, None], at + 1, 0)
        side = (b[..., 0] - a[..., 0]) * (ring[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (ring[..., 0] - a[..., 0])
        far = np.take_along_axis(side, after, axis=1)
        to = np.take_along_axis(ring, after[..., None], axis=1)
        crosses = real & (((side > 0) & (far < 0)) | ((side < 0) & (far > 0)))
        share = np.where(crosses, side / np.where(crosses, side - far, 1.0), 0.0)[..., None]
        both = np.stack([ring, ring + share * (to - ring)], axis=2).reshape(len(ring), 2 * n, 2)
        valid = np.stack([real & (side >= 0), crosses], axis=2).reshape(len(ring), 2 * n)
        count = valid.sum(axis=1)
        order = np.argsort(~valid, axis=1, kind="stable")[:, : max(int(count.max()), 1)]
        ring = np.take_along_axis(both, order[..., None], axis=1)
    last = np.minimum(np.arange(ring.shape[1]), np.maximum(count - 1, 0)[:, None])
    whole = area(np.take_along_axis(ring, last[..., None], axis=1))  # the last corner stands in for those that are not there
    out[meets] = np.where(count < 3, 0.0, whole)
    return out


def widened(ring: np.ndarray, by: np.ndarray, arc: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, area) of quads moved outwards by ``by``, as :func:`vellum.functions.polygons.widened` does: arcs of n steps at each corner."""
    edge = np.roll(ring, -1, axis=1) - ring
    out = np.arctan2(-edge[..., 0], edge[..., 1])
    start = np.roll(out, 1, axis=1)
    turn = out - start
    sweep = turn - 2 * np.pi * np.floor(turn / (2 * np.pi))
    step = 2 * np.arccos(np.maximum(0.0, 1 - arc / by))
    n = np.maximum(1, np.ceil(sweep / step[:, None])).astype(np.int64)
    each = n.ravel() + 1
    corner = np.repeat(np.arange(len(each)), each)
    j = np.arange(len(corner)) - np.repeat(np.cumsum(each) - each, each)
    angle = start.ravel()[corner] + sweep.ravel()[corner] * j / n.ravel()[corner]
    far = np.repeat(by, 4)[corner]
    x, y = (ring[..., k].ravel()[corner] + far * f(angle) for k, f in ((0, np.cos), (1, np.sin)))
    count = (n + 1).sum(axis=1)
    first = np.cumsum(count) - count
    after = np.arange(1, len(x) + 1)
    after[first + count - 1] = first
    return count, np.abs(np.add.reduceat(x * y[after] - x[after] * y, first)) / 2 if len(x) else np.zeros(0)
