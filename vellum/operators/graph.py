"""Connected components of an edge table, by alternating large-star and small-star steps.

First each batch of edges is joined up by itself and goes on as stars, so that
components whose edges lie together, such as those of a page, are done at once
and the others have fewer edges; where that leaves each node one label, nothing else runs. Every step after that is a join and a grouped
minimum over the edges left, so no node's neighbours meet in one task but as
partial minima, and the driver sees only a count and a checksum. The number of
steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.sources.scratch import Scratch


def least_of_each(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of the edges u[k] - v[k]."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:  # up to the roots
            up = root[root]
            if (up == root).all():
                break
            root = up


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, least = least_of_each(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        on = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on], pa.int64()), pa.array(least[on], pa.int64())], names=["u", "v"])


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(_nearest(both), "large")
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.write(_nearest(down), "small")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _settled(stars: DataFrame) -> bool:
    """Whether each node has one label: then the batches have joined up everything, as where each page's edges lie together."""
    both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), "v"))
    return both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").limit(1).count() == 0


def _labels(stars: DataFrame) -> DataFrame:
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected_components(edges: DataFrame, scratch: Scratch, max_steps: int = 60) -> DataFrame:
    """Label each node of ``edges`` (u, v: long) with the least node of its component.

    Returns (node, component), a row for each node that has an edge to another
    node. Self-loops, repeated edges and either direction are fine; edges with a
    null end are left out; no edges give no rows.
    """
    held = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    now = scratch.write(held.mapInArrow(_starred, "u long, v long").distinct(), "edges")
    if _settled(now):
        return _labels(now)
    before = _mark(now)
    for _ in range(max_steps):
        large = scratch.write(_large_star(now, scratch), "large-star")
        scratch.release(now)
        now = scratch.write(_small_star(large, scratch), "small-star")
        scratch.release(large)
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return _labels(now)
