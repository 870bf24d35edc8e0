"""Regions of text lines: candidate pairs, their components, the recursive split, and what a region holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.functions.geometry import box_gap, can_merge, can_merge_quads
from vellum.operators import quads as Q
from vellum.operators.graph import connected_components
from vellum.sources.scratch import Scratch

#: Tolerances of the merge test, and of the test that groups lines by direction.
MERGE = {"aspect": 1.3, "fonts": 2.0, "gap": 1.0, "gap2": 3.0}
DIRECTION = {"aspect": 1.0, "fonts": 1.5, "gap": 0.6, "gap2": 1.5}


def page_pairs(lines: DataFrame) -> DataFrame:
    """Unordered pairs of a page's lines, columns prefixed a_ and b_; an equi-join on the page."""
    held = [c for c in ("line_id", "x", "y", "w", "h", "node") if c in lines.columns]
    a = lines.select("page_id", *[F.col(c).alias(f"a_{c}") for c in held])
    b = lines.select("page_id", *[F.col(c).alias(f"b_{c}") for c in held])
    return a.join(b, "page_id").where("a_line_id < b_line_id")


#: Side of a cell in pixels.
CELL = 256


def near_pairs(lines: DataFrame, reach: float = 0.0, cell: int = CELL) -> DataFrame:
    """The :func:`page_pairs` of boxes no further apart than ``reach`` times their mean font: a join on page and cell of a grid.

    A box, with a margin of half of ``reach`` times its font, stands in the cells that it
    covers. Boxes that near have margins that meet, and the cell where their common
    part begins has the pair, so it comes once. A page of any number of lines is dealt out by its cells.
    """
    held = [c for c in ("line_id", "x", "y", "w", "h", "node") if c in lines.columns]
    margin = F.least("w", "h") * (reach / 2)
    low, high = {c: F.floor((F.col(c) - margin) / cell) for c in "xy"}, {c: F.floor((F.col(c) + F.col(s) + margin) / cell) for c, s in zip("xy", "wh")}
    placed = lines.withColumns({"_lx": low["x"], "_ly": low["y"]}).withColumn("_cx", F.explode(F.sequence("_lx", high["x"]))).withColumn("_cy", F.explode(F.sequence("_ly", high["y"])))
    a, b = (placed.select("page_id", "_cx", "_cy", *[F.col(c).alias(f"{s}_{c.strip('_')}") for c in (*held, "_lx", "_ly")]) for s in "ab")
    both = a.join(b, ["page_id", "_cx", "_cy"]).where("a_line_id < b_line_id")
    return both.where((F.col("_cx") == F.greatest("a_lx", "b_lx")) & (F.col("_cy") == F.greatest("a_ly", "b_ly"))).drop("_cx", "_cy", "a_lx", "b_lx", "a_ly", "b_ly")


def candidate_pairs(lines: DataFrame, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """Pairs that pass the merge test: it wants a distance below the smaller font times ``gap``, and twice that font at most."""
    return near_pairs(lines, min(2.0, tolerances["gap"])).where(can_merge("a", "b", **tolerances))


def merge_pairs(lines: DataFrame, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """(page_id, src, dst, distance) of the pairs that pass the merge test."""
    good = candidate_pairs(lines, tolerances)
    return good.select("page_id", F.col("a_line_id").alias("src"), F.col("b_line_id").alias("dst"), box_gap("a", "b").alias("distance"))


def _find(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _components(nodes: list, edges: list) -> list[list]:
    parent = {n: n for n in nodes}
    for u, v in edges:
        a, b = _find(parent, u), _find(parent, v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups: dict[int, list] = {}
    for n in nodes:
        groups.setdefault(_find(parent, n), []).append(n)
    return list(groups.values())


def _tree(nodes: list[int], gap: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a least spanning tree, heaviest first; equal weights in the order of the nodes."""
    every = sorted((gap[u, v], u, v) for i, u in enumerate(nodes) for v in nodes[i + 1 :])
    parent, kept = {n: n for n in nodes}, []
    for d, u, v in every:
        a, b = _find(parent, u), _find(parent, v)
        if a != b:
            parent[a] = b
            kept.append((float(d), u, v))
    return sorted(kept, key=lambda e: -e[0])


#: Fonts between two lines of a pair, and how far their directions may differ.
PAIR_FONTS, PAIR_TURN = 1.5, 0.2 * np.pi


def _split(nodes: list[int], gap: np.ndarray, font: np.ndarray, centre: np.ndarray, angle: np.ndarray | None = None) -> list[list[int]]:
    """A component in regions: pairs by distance and direction, larger ones cut at the tree's heaviest edge until they hold together.

    Upright boxes all have the same direction.
    """
    todo, done = [nodes], []
    while todo:
        group = todo.pop()
        if len(group) == 1:
            done.append(group)
        elif len(group) == 2:
            u, v = group
            close = gap[u, v] < PAIR_FONTS * max(font[u], font[v]) and (angle is None or abs(angle[u] - angle[v]) < PAIR_TURN)
            done.extend([group] if close else [[u], [v]])
        else:
            edges = _tree(group, gap)
            far = np.array([e[0] for e in edges])
            mean_font, spread = float(np.mean(font[group])), float(far.std())
            _, u, v = edges[0]
            aligned = min(abs(centre[u] - centre[v]))
            even = far[0] <= far.mean() + 2 * spread or far[0] <= 1.5 * mean_font
            tight = spread < max(0.3 * mean_font + 5, 5) or (gap[u, v] == 0 and aligned < 5)
            if even and tight:
                done.append(group)
            else:
                todo.extend(_components(group, [e[1:] for e in edges[1:]]))
    return done


def split_shared(bubbles: DataFrame) -> DataFrame:
    """(page_id, line_id, x, y, w, h) and what other columns there are of ``bubbles``, a rectangle x, y, w, h and a centre cx, cy for each line, where those of IoU 0.5 and more have shared out their ground.

    Pairs go in the order of their lines, and a cut holds for the pairs after it,
    so a page with an overlap is one array and its fold. The first rectangle of a
    pair is cut half-way between the centres, along the axis on which they are
    further apart, 10 pixels from its edges at least; both parts are of it.
    """
    others = [c for c in bubbles.columns if c not in ("page_id", "line_id", "cx", "cy", *"xywh")]
    box = F.struct("line_id", "cx", "cy", *[F.col(c).cast("long").alias(c) for c in "xywh"], *others)
    pages = bubbles.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    last = F.size("boxes") - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i < last, F.transform(F.sequence(F.least(i + 1, last), last), lambda j: F.struct(i.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))))

    def alike(p: Column, q: Column) -> Column:
        across = F.greatest(F.least(p["x"] + p["w"], q["x"] + q["w"]) - F.greatest(p["x"], q["x"]), F.lit(0))
        down = F.greatest(F.least(p["y"] + p["h"], q["y"] + q["h"]) - F.greatest(p["y"], q["y"]), F.lit(0))
        union = p["w"] * p["h"] + q["w"] * q["h"] - across * down
        return (union > 0) & (2 * across * down >= union)

    def parts(p: Column, q: Column) -> tuple[Column, Column]:
        along = F.abs(p["cx"] - q["cx"]) > F.abs(p["cy"] - q["cy"])
        leads = F.when(along, p["cx"] <= q["cx"]).otherwise(p["cy"] <= q["cy"])
        cut = lambda c, size: F.greatest(p[c] + 10, F.least(((p[f"c{c}"] + q[f"c{c}"]) / 2).cast("long"), p[c] + p[size] - 10))
        sx, sy = cut("x", "w"), cut("y", "h")
        part = lambda r, first: F.struct(
            r["line_id"].alias("line_id"), r["cx"].alias("cx"), r["cy"].alias("cy"),
            F.when(along & ~first, sx).otherwise(p["x"]).alias("x"), F.when(~along & ~first, sy).otherwise(p["y"]).alias("y"),
            F.when(~along, p["w"]).when(first, sx - p["x"]).otherwise(p["x"] + p["w"] - sx).alias("w"), F.when(along, p["h"]).when(first, sy - p["y"]).otherwise(p["y"] + p["h"] - sy).alias("h"),
            *[r[c].alias(c) for c in others],
        )
        return part(p, leads), part(q, ~leads)

    def settle(boxes: Column, pair: Column) -> Column:
        p, q = F.get(boxes, pair["i"]), F.get(boxes, pair["j"])
        one, two = parts(p, q)
        return F.when(alike(p, q), F.transform(boxes, lambda b, k: F.when(k == pair["i"], one).when(k == pair["j"], two).otherwise(b))).otherwise(boxes)

    some = F.exists(pairs, lambda pair: alike(F.get("boxes", pair["i"]), F.get("boxes", pair["j"])))
    done = F.when(some, F.aggregate(pairs, F.col("boxes"), settle)).otherwise(F.col("boxes"))
    return pages.select("page_id", F.explode(done).alias("b")).select("page_id", "b.line_id", "b.x", "b.y", "b.w", "b.h", *[f"b.{c}" for c in others])


def line_components(lines: DataFrame, scratch: Scratch, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """page_id, line_id, x, y, w, h, component: a number that the lines joined by merge pairs share.

    Lines are numbered as they are written, so no page can hold too many of them,
    and components form over all pages at once, however large a page is.
    """
    held = lines.select("page_id", "line_id", "x", "y", "w", "h", F.monotonically_increasing_id().alias("node"))
    held = scratch.write(held, "lines", keep=True)
    edges = candidate_pairs(held, tolerances).select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
    labels = scratch.write(connected_components(edges, scratch), "labels", keep=True)
    joined = held.join(labels, "node", "left")
    return joined.select("page_id", "line_id", "x", "y", "w", "h", F.coalesce("component", "node").alias("component"))


REGIONS = "page_id long, line_id long, region_id long, tree_weight double"
_REGIONS = pa.schema([("page_id", pa.int64()), ("line_id", pa.int64()), ("region_id", pa.int64()), ("tree_weight", pa.float64())])


def _split_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many components a batch: rows of (page_id, lines by line_id). Those of one or two lines are settled as arrays."""
    for batch in batches:
        lists = batch.column(1)
        start = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        ids = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        x, y, w, h = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(1, 5))
        sizes = np.diff(start)
        region, weight = ids.copy(), np.zeros(len(ids))
        font = np.minimum(w, h)
        two = start[:-1][sizes == 2]
        gap = np.hypot(*(np.maximum(np.maximum(p[two + 1] - (p + q)[two], p[two] - (p + q)[two + 1]), 0) for p, q in ((x, w), (y, h))))
        weight[two] = weight[two + 1] = gap
        near = gap < PAIR_FONTS * np.maximum(font[two], font[two + 1])
        region[two[near] + 1] = ids[two[near]]
        for k in np.flatnonzero(sizes > 2).tolist():
            here = slice(int(start[k]), int(start[k + 1]))
            a, b, c, d = x[here], y[here], w[here], h[here]
            dx = np.maximum(np.maximum(a[None] - (a + c)[:, None], a[:, None] - (a + c)[None]), 0)
            dy = np.maximum(np.maximum(b[None] - (b + d)[:, None], b[:, None] - (b + d)[None]), 0)
            gaps, nodes = np.hypot(dx, dy), list(range(len(a)))
            weight[here] = sum(e[0] for e in _tree(nodes, gaps))
            for part in _split(nodes, gaps, font[here], np.stack([a + c / 2, b + d / 2], axis=1)):
                region[here.start + np.array(part)] = ids[here.start + min(part)]
        pages = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        first, last = int(start[0]), int(start[-1])
        yield pa.RecordBatch.from_arrays([pa.array(pages), pa.array(ids[first:last]), pa.array(region[first:last]), pa.array(weight[first:last])], schema=_REGIONS)


def regions(lines: DataFrame, scratch: Scratch, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """(page_id, line_id, region_id, tree_weight): region_id is the least line of the region, tree_weight the sum of its component's tree.

    A component is the unit of work, not a page; its split looks at all pairs of its lines.
    """
    line = F.struct("line_id", "x", "y", "w", "h")
    parts = line_components(lines, scratch, tolerances).groupBy("page_id", "component").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return parts.select("page_id", "lines").mapInArrow(_split_all, REGIONS)


TREES = "page_id long, first long, lines long, weight array<double>, mean_font double"


def tree_edges(lines: DataFrame, scratch: Scratch, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """page_id, first (the component's least line), lines, weight (of the edges of its least spanning tree, heaviest first) and mean_font, for components of two lines and more."""
    line = F.struct("line_id", "x", "y", "w", "h")
    parts = line_components(lines, scratch, tolerances).groupBy("page_id", "component").agg(F.array_sort(F.collect_list(line)).alias("lines")).where(F.size("lines") > 1)

    return parts.select("page_id", "lines").mapInArrow(_trees, TREES)


#: Lines of components that are looked at together.
TOGETHER = 1 << 16


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:data:`TREES` of components (page_id, lines by line_id), those of as many lines together."""
    for batch in batches:
        lists = batch.column(1)
        start = lists.offsets.to_numpy().astype(np.int64)
        sizes, start = np.diff(start), start[:-1] - start[0]
        flat, pages = lists.flatten(), batch.column(0).to_numpy(zero_copy_only=False)
        ids, boxes = flat.field(0).to_numpy(zero_copy_only=False), [flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(1, 5)]
        for size in np.unique(sizes).tolist():
            these, some = np.flatnonzero(sizes == size), max(1, TOGETHER // size)
            for low in range(0, len(these), some):
                at = these[low : low + some]
                x, y, w, h = (c[start[at][:, None] + np.arange(size)] for c in boxes)
                weight = tree_weights(x, y, w, h)
                ends = pa.array(np.arange(len(at) + 1) * (size - 1), pa.int32())
                columns = [pa.array(pages[at], pa.int64()), pa.array(ids[start[at]], pa.int64()), pa.array(np.full(len(at), size), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(weight.ravel())), pa.array(np.minimum(w, h).mean(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "first", "lines", "weight", "mean_font"])


def tree_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Weights, heaviest first, of the least spanning tree of each row's boxes; they are the same for every such tree.

    The nearest box outside joins next, so a row needs its boxes' distances to the last that joined, not all pairs.
    """
    n, size = x.shape
    row, out = np.arange(n), np.zeros((n, size - 1))
    near, joined, last = np.full((n, size), np.inf), np.zeros((n, size), bool), np.zeros(n, np.int64)
    away = lambda p, q, o: np.maximum(np.maximum(p - (p + q)[row, o][:, None], p[row, o][:, None] - (p + q)), 0)
    for k in range(size - 1):
        joined[row, last] = True
        near = np.where(joined, np.inf, np.minimum(near, np.hypot(away(x, w, last), away(y, h, last))))
        last = near.argmin(axis=1)
        out[:, k] = near[row, last]
    return -np.sort(-out, axis=1)


def tilted_pairs(quads: DataFrame, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """Pairs of a page's tilted lines that pass the merge test, columns prefixed a_ and b_, with their distance ``gap``.

    The distance of the lines' bounds, which is no larger, decides first: every rule wants a small distance.
    """
    a, b = (quads.select("page_id", *[F.col(c).alias(f"{s}_{c}") for c in quads.columns if c != "page_id"]) for s in "ab")
    near = a.join(b, "page_id").where("a_line_id < b_line_id").withColumn("gap", box_gap("a", "b") - 1e-6)
    near = near.where(can_merge_quads("a", "b", **tolerances)).drop("gap")
    with_gap = Q.with_figures(near, "gap double", lambda rows: [Q.gaps(Q.rings(rows, "a_p"), Q.rings(rows, "b_p"))], drop=("a_p", "b_p"))
    return with_gap.where(can_merge_quads("a", "b", **tolerances))


def tilted_regions(quads: DataFrame, scratch: Scratch, tolerances: dict[str, float] = MERGE) -> DataFrame:
    """(page_id, line_id, region_id) of ``quads`` (page_id, line_id, p and the columns of its shape).

    Components of the merge pairs form over all pages at once; a component is the unit of the split, which looks at all pairs of its lines.
    """
    held = scratch.write(quads.withColumn("node", F.monotonically_increasing_id()), "quads", keep=True)
    edges = tilted_pairs(held, tolerances).select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
    labels = scratch.write(connected_components(edges, scratch), "labels", keep=True)
    joined = held.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = joined.groupBy("page_id", "component").agg(F.array_sort(F.collect_list(F.struct("line_id", "font", "angle", "p"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            start = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            flat = lists.flatten()
            ids, font, angle = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            p = Q.rings(pa.RecordBatch.from_arrays([flat.field(3)], names=["p"]), "p")
            sizes, region = np.diff(start), ids.copy()
            two = start[:-1][sizes == 2]
            close = (Q.gaps(p[two], p[two + 1]) < PAIR_FONTS * np.maximum(font[two], font[two + 1])) & (np.abs(angle[two] - angle[two + 1]) < PAIR_TURN)
            region[two[close] + 1] = ids[two[close]]
            for k in np.flatnonzero(sizes > 2).tolist():
                here = slice(int(start[k]), int(start[k + 1]))
                for part in _split(list(range(int(sizes[k]))), ring_gaps(p[here]), font[here], p[here].mean(axis=1), angle[here]):
                    region[here.start + np.array(part)] = ids[here.start + min(part)]
            pages = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (pages, ids, region)], names=["page_id", "line_id", "region_id"])

    return parts.select("page_id", "lines").mapInArrow(run, "page_id long, line_id long, region_id long")


def ring_gaps(p: np.ndarray) -> np.ndarray:
    """Distances of all pairs of convex rings (n, corners, 2): 0 where they meet or one holds the other."""
    n, m = p.shape[:2]
    edge = np.roll(p, -1, axis=1) - p
    normal = np.stack([-edge[..., 1], edge[..., 0]], axis=-1)
    along = np.einsum("akc,bjc->abkj", normal, p)  # corners of b along the normals of a
    own = np.einsum("akc,ajc->akj", normal, p)[:, None]
    apart = ((along.min(axis=3) > own.max(axis=3)) | (along.max(axis=3) < own.min(axis=3))).any(axis=2)
    apart |= apart.T
    off = p[None, :, None, :, :] - p[:, None, :, None, :]  # from the start of each edge of a to each corner of b
    e = edge[:, None, :, None, :]
    at = np.clip((off * e).sum(axis=-1) / np.maximum((e * e).sum(axis=-1), 1e-12), 0, 1)
    far = ((off - at[..., None] * e) ** 2).sum(axis=-1).reshape(n, n, m * m).min(axis=2)
    return np.where(apart, np.sqrt(np.minimum(far, far.T)), 0.0)
