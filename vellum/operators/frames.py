"""Many images at once: stacks (n, h, w) of frames as large as the largest of them. Numpy inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from vellum.operators.masks import runs
from vellum.sources.tables import spread

#: Pixels of frames that are worked on at once; sides of frames differ by less than this.
FRAMED, ALIKE = 1 << 19, 8

Draw = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


class Stack(NamedTuple):
    """Images of nearly the same size; a frame has no pixel beyond its image's ``w`` and ``h``."""

    batch: pa.RecordBatch
    w: np.ndarray
    h: np.ndarray
    grey: np.ndarray

    @property
    def image_id(self) -> np.ndarray:
        return self.batch.column("image_id").to_numpy()

    def inside(self) -> np.ndarray:
        return within(self.w, self.h, self.grey.shape)

    def lists(self, name: str) -> tuple[np.ndarray, pa.Array]:
        """The image (place in the stack) of each element of a column of arrays, and the elements."""
        lists = self.batch.column(name)
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()


def within(w: np.ndarray, h: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Which pixels of frames are of images w x h."""
    return (np.arange(shape[1]) < h[:, None])[:, :, None] & (np.arange(shape[2]) < w[:, None])[:, None, :]


def over_frames(images: DataFrame, schema: str, each: Callable[[Stack], list], draw: Draw | None = None) -> DataFrame:
    """Columns of ``each`` for images (image_id, w, h, others), many at once, under the names of ``schema``.

    Pixels come from an array ``grey``, row by row, or are drawn in the task that looks at them: ``draw``(columns, x, y), as
    for :func:`vellum.operators.masks.drawn`, of columns (n, 1, 1), x (1, 1, w) and y (1, h, 1). Images to draw are dealt out by their id.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    flat = [f.name for f in images.schema.fields if not isinstance(f.dataType, ArrayType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stack in stacks(batch, flat, draw):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(each(stack), arrow)], schema=arrow)

    return (images if draw is None else spread(images, "image_id")).mapInArrow(run, schema)


def stacks(batch: pa.RecordBatch, flat: list[str], draw: Draw | None) -> Iterator[Stack]:
    w, h = (batch.column(c).to_numpy().astype(np.int64) for c in "wh")
    order = np.lexsort((w // ALIKE, h // ALIKE))
    alike = np.stack([h[order] // ALIKE, w[order] // ALIKE])
    turns = np.flatnonzero(np.diff(alike, axis=1, prepend=alike[:, :1] - 1).any(axis=0)).tolist()
    for low, high in zip(turns, [*turns[1:], len(order)]):
        some = max(1, FRAMED // max(1, int(h[order[low:high]].max() * w[order[low:high]].max())))
        for start in range(low, high, some):
            at = order[start : min(start + some, high)]
            part = batch.take(pa.array(at))
            shape = (len(at), int(h[at].max()), int(w[at].max()))
            inside = within(w[at], h[at], shape)
            if draw is None:
                grey = np.zeros(shape, np.int64)
                grey[inside] = part.column("grey").flatten().to_numpy(zero_copy_only=False)
            else:
                held = {c: part.column(c).to_numpy(zero_copy_only=False)[:, None, None] for c in flat}
                grey = np.where(inside, draw(held, np.arange(shape[2])[None, None, :], np.arange(shape[1])[None, :, None]), 0)
            yield Stack(part, w[at], h[at], small(grey))


def small(grey: np.ndarray) -> np.ndarray:
    """Whole numbers in 16 bits where they and their sums of 16 fit."""
    if grey.dtype == np.int16 or not grey.size or (grey.min() >= 0 and grey.max() < 2048):
        return grey.astype(np.int16, copy=False)
    return grey.astype(np.int64, copy=False)


def remainder(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """(a + b) % by; with a and b of fewer pixels than their sum, most of it is in 8 bits."""
    a, b = ((v % by).astype(np.uint8 if by <= 128 else np.int64) for v in (a, b))
    out = a + b
    return np.where(out >= by, out - by, out)


def rounded(v: np.ndarray) -> list[float]:
    """Figures to six places, rounded as Python does."""
    return [round(x, 6) for x in v.tolist()]


def painted(owner: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Frames of ``shape`` with the pixels from ``low`` to before ``high`` of a row set; runs of a row neither meet nor touch."""
    n, h, w = shape
    turns = np.zeros((n, h, w + 1), np.int8)
    turns[owner, row, low] = 1
    turns[owner, row, high] = -1
    return np.cumsum(turns, axis=2, dtype=np.int8)[:, :, :w] > 0


def windowed(masks: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Whether all of the 2 * reach + 1 pixels along an axis are set, those before and beyond the frame left out."""
    wide, held = 2 * reach + 1, 1
    pad = [(0, 0)] * 3
    pad[axis] = (reach, reach)
    out = np.moveaxis(np.pad(masks, pad, constant_values=True), axis, 0)
    while 2 * held <= wide:
        out, held = out[:-held] & out[held:], 2 * held
    if wide > held:
        out = out[: held - wide] & out[wide - held :]
    return np.moveaxis(out, 0, axis)


def dilated(masks: np.ndarray, halves: list[int]) -> np.ndarray:
    """Pixels within a kernel of a set one, by the half widths of its rows."""
    h, r = masks.shape[1], len(halves) // 2
    across = {half: ~windowed(~masks, half, 2) if half else masks for half in set(halves)}
    out = np.zeros_like(masks)
    for dy, half in zip(range(-r, r + 1), halves):
        low, high = max(0, dy), min(h, h + dy)
        if low < high:
            out[:, low:high] |= across[half][:, low - dy : high - dy]
    return out


class Parts(NamedTuple):
    """Components of masks by the run that they begin with: pixels and bounds (right and bottom are the last pixels)."""

    root: np.ndarray
    mask: np.ndarray
    area: np.ndarray
    left: np.ndarray
    top: np.ndarray
    right: np.ndarray
    bottom: np.ndarray


class Runs(NamedTuple):
    """Runs of set pixels of masks, by mask and row; ``least`` is the first run of each one's component."""

    mask: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    starts: np.ndarray
    shape: tuple[int, int, int]

    def at(self, mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The component of set pixels, by its first run."""
        _, h, w = self.shape
        return self.least[np.searchsorted(self.starts, (mask * (h + 1) + y) * (w + 1) + x, side="right") - 1]

    def parts(self, root: np.ndarray | None = None) -> tuple[Parts, np.ndarray, np.ndarray]:
        """Components (sorted first runs; else all), their runs one component after another, and each of these runs' place among the components."""
        root = np.flatnonzero(self.least == np.arange(len(self.least))) if root is None else root
        place = np.full(len(self.least), -1)
        place[root] = np.arange(len(root))
        of = place[self.least]
        order = np.argsort(of, kind="stable")
        order = order[np.searchsorted(of[order], 0) :]
        of = of[order]
        first = np.searchsorted(of, np.arange(len(root)))
        last = np.append(first[1:], len(of)) - 1
        by = lambda f, v: f.reduceat(v, first) if len(root) else v[:0]
        low, high = self.low[order], self.high[order]
        return Parts(root, self.mask[root], by(np.add, high - low), by(np.minimum, low), self.row[order[first]], by(np.maximum, high) - 1, self.row[order[last]]), order, of


def runs_of(masks: np.ndarray, corners: bool) -> Runs:
    from vellum.operators.masks import runs

    _, h, w = masks.shape
    starts, ends, least = runs(masks, corners)
    line, low = np.divmod(starts, w + 1)
    mask, row = np.divmod(line, h + 1)
    return Runs(mask, row, low, low + ends - starts, least, starts, masks.shape)


def inscribed(masks: np.ndarray) -> np.ndarray:
    """(x, y, w, h) of the largest rectangle of set pixels of each mask, by the rule of :func:`vellum.operators.masks.inscribed_rectangle`."""
    n, h, w = masks.shape
    out = np.zeros((n, 4), np.int64)
    if not masks.any():
        return out
    heights = np.zeros((n, h, w), np.int16 if h < 1 << 15 else np.int64)
    above = heights[:, 0]
    for row in range(h):
        above = heights[:, row] = np.where(masks[:, row], above + 1, 0)
    least, best, at = heights.copy(), np.zeros(n, np.int64), np.arange(n)
    for wide in range(1, w + 1):
        if wide > 1:
            np.minimum(least[:, :, : w - wide + 1], heights[:, :, wide - 1 :], out=least[:, :, : w - wide + 1])
            least[:, :, w - wide + 1] = 0
        first = least.reshape(n, -1).argmax(axis=1)
        tall = least.reshape(n, -1)[at, first].astype(np.int64)
        if not (tall * w >= best // (h * (w + 1) ** 2)).any() or not tall.any():  # no wider run can reach the best
            break
        row, start = np.divmod(first, w)
        # the area, and then what comes first: row, right end, width
        np.maximum(best, (((tall * wide) * h + h - 1 - row) * (w + 1) + w - start - wide) * (w + 1) + w - wide, out=best)
    best, wide = np.divmod(best, w + 1)
    best, right = np.divmod(best, w + 1)
    area, row = np.divmod(best, h)
    wide, right, row = w - wide, w - right, h - 1 - row
    tall = area // np.maximum(wide, 1)
    out[area > 0] = np.stack([right - wide, row - tall + 1, wide, tall], axis=1)[area > 0]
    return out
