"""Hard negatives by dual-tree search.

Vectors become whole numbers, floor(256 * x). Anchors and candidates are each laid out
along a ball tree: :func:`splits` cuts a bounded sample of the candidates in halves
along their widest direction, every row goes down these cuts to a cell, and cells
are packed in blocks of at most :data:`BLOCK` rows, a row of a table each, with a
ball tree of their own inside. From centres and radii follows an interval that holds all
inner products of a node pair. The search compares

1. block with block: a pair whose upper end is below what the anchors still need goes,
   for the whole anchor block at once;
2. within a pair that stays, nodes of both trees, level by level, pruned in the
   same way; leaf pairs are scored exactly, in whole numbers.

First each anchor block meets the candidate block that promises most, which gives a
bound to prune by; then all others. Positives come first; their scores set the windows that
negatives have to lie in, so the second search prunes at both ends.

Identical rows of one label matter only by their smallest ids, as ties go by id: each such
class keeps the first :data:`FIRST` + 1 (an anchor doesn't count itself). That is exact,
and keeps a hot vector from filling a cell. Nothing else is left out: cuts fitted on a
sample only say where rows lie, every row is indexed, and the results are exact, recall 1.

Defined results: rows with a null id, label or vector, or with a component that is null
or not finite, take no part; an id that repeats counts once, with its least label and then
vector; shorter vectors count as padded with zeros; components beyond +-2^24 count as
that, so that scores fit a long; further columns do no harm, as only three are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vellum.llm.rows import small_batches
from vellum.sources.scratch import Scratch

#: Positives of an anchor and negatives of a positive; percentage of the positive's score from which a negative counts.
FIRST, LEAST_PERCENT = 5, 80
#: Every 100th id is an anchor; every 7th id has the next of 10 labels.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
#: Rows of a block, of a leaf inside it; rows of the sample that the cuts are fitted on, at most, and its components; rows a cell should have.
BLOCK, LEAF, SAMPLE, SAMPLE_VALUES, CELL = 8192, 256, 20_000, 4_000_000, 4096
#: Anchor blocks that a candidate block is compared with at a time.
BUNDLE = 256
_MOST, _LEAST_SCORE, _NO_ID = 1 << 24, -(2**63 - 1), 2**63 - 1


def whole(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each id once."""
    held = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).alias("x")).dropna()
    held = held.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    cut = lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(_MOST)), F.lit(-_MOST)).cast("int")
    return held.groupBy("vec_id").agg(F.min(F.struct(label.alias("label"), F.transform("x", cut).alias("v"))).alias("r")).select("vec_id", "r.label", "r.v")


class Splits(NamedTuple):
    """Cuts of a complete binary tree in level order: a direction and a value each."""

    direction: np.ndarray
    value: np.ndarray

    def top(self, rows: int) -> Splits:
        """The upper cuts alone, so that a cell has some CELL of ``rows``."""
        n = min(len(self.value), 2 ** max(0, int(np.ceil(np.log2(max(1, rows) / CELL)))) - 1)
        return Splits(self.direction[:n], self.value[:n])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The leaf, from 0, that each row comes to."""
        at = np.zeros(len(x), np.int64)
        for _ in range(int(len(self.value) + 1).bit_length() - 1):
            right = (x * self.direction[at]).sum(axis=1) > self.value[at]
            at = 2 * at + 1 + right
        return at - len(self.value)


def splits(sample: np.ndarray, rows: int) -> Splits:
    """Halving cuts until a cell has some CELL of ``rows``, or the sample too few to cut."""
    depth = max(0, min(int(np.ceil(np.log2(max(1, rows) / CELL))), int(np.log2(max(8, len(sample)) / 8))))
    d = sample.shape[1]
    direction, value = np.zeros((2**depth - 1, d)), np.zeros(2**depth - 1)
    parts = {0: sample}
    for node in range(2**depth - 1):
        part = parts.pop(node)
        if len(part):
            direction[node] = widest(part)
            along = part @ direction[node]
            value[node] = np.median(along)
            right = along > value[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = part
    return Splits(direction, value)


def widest(x: np.ndarray) -> np.ndarray:
    """A unit direction along which rows differ most, by a few power steps."""
    y = x - x.mean(axis=0)
    w = y[np.argmax((y * y).sum(axis=1))].copy() if len(y) else np.zeros(x.shape[1])
    for _ in range(4):
        norm = np.linalg.norm(w)
        if norm == 0:
            break
        w = y.T @ (y @ (w / norm))
    norm = np.linalg.norm(w)
    return w / norm if norm else w


class Tree(NamedTuple):
    """Nodes in level order over rows that are laid out along the leaves: centres, radii, and the rows [start, end) of each."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tree(x: np.ndarray) -> Tree:
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
    order, nodes = np.arange(len(x)), [(0, len(x))]
    for node in range(2**depth - 1):
        start, end = nodes[node]
        here = order[start:end]
        middle = (start + end) // 2
        if end - start > 1:
            along = x[here] @ widest(x[here])
            order[start:end] = here[np.argpartition(along, middle - start)]
        nodes += [(start, middle), (middle, end)]
    centre, radius = np.zeros((len(nodes), x.shape[1])), np.zeros(len(nodes))
    for k, (start, end) in enumerate(nodes):
        if end > start:
            part = x[order[start:end]]
            centre[k] = part.mean(axis=0)
            radius[k] = np.sqrt(((part - centre[k]) ** 2).sum(axis=1).max())
    return Tree(order, centre, radius, np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]))


def intervals(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the interval that holds all inner products of balls a and b, pair by pair; wider by what rounding may take."""
    middle = (ca * cb).sum(axis=-1)
    na, nb = np.linalg.norm(ca, axis=-1), np.linalg.norm(cb, axis=-1)
    wide = (na * rb + nb * ra + ra * rb) * (1 + 1e-9) + 1e-6 * (1 + na * nb)
    return middle - wide, middle + wide


BLOCKS = "block bigint, n int, ids binary, labels binary, v binary, radius double, centre binary"


def _packed(frame: pd.DataFrame, d: int) -> tuple:
    """n, ids, labels, v, radius, centre of rows in the order of their tree."""
    v = np.zeros((len(frame), d), np.int32)
    for k, row in enumerate(frame["v"]):
        v[k, : len(row)] = row
    t = tree(v.astype(float))
    o = t.order
    return len(o), frame["vec_id"].to_numpy(np.int64)[o].tobytes(), frame["label"].to_numpy(np.int32)[o].tobytes(), v[o].tobytes(), float(t.radius[0]), t.centre[0].tobytes()


def blocks(rows: DataFrame, cuts: Splits, d: int, scratch: Scratch, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``rows`` by cell: hot cells are parted by a hash of the id, so a block has some BLOCK rows at most."""
    small_batches(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(cuts)  # bounded by the sample

    @F.pandas_udf("bigint")
    def cell(vs: pd.Series) -> pd.Series:
        x = np.zeros((len(vs), d))
        for k, row in enumerate(vs):
            x[k, : len(row)] = row
        return pd.Series(np.concatenate([held.value.cells(x[k : k + 4096]) for k in range(0, len(x), 4096)] or [np.empty(0, np.int64)]))

    placed = scratch.write(rows.withColumn("cell", cell("v")), f"{name}-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (0.75 * BLOCK)).alias("parts"))
    numbered = placed.join(sizes, "cell").withColumn("block", F.xxhash64("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", ignore_index=True)
        return pd.DataFrame([(int(frame["block"].iloc[0]), *_packed(frame, d))], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return scratch.write(numbered.select("block", "vec_id", "label", "v").groupBy("block").applyInPandas(pack, BLOCKS), name)


class Side(NamedTuple):
    """A block as arrays, with its tree."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    tree: Tree


def _side(ids: bytes, labels: bytes, v: bytes, d: int) -> Side:
    ids_, labels_, v_ = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int32), np.frombuffer(v, np.int32).reshape(-1, d)
    t = tree(v_.astype(float))
    return Side(ids_[t.order], labels_[t.order], v_[t.order], t)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by floats while these hold them, else by longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The first FIRST candidates, by score and then id, of each of n asks."""

    def __init__(self, least: np.ndarray) -> None:
        self.score = np.full((len(least), FIRST), _LEAST_SCORE)
        self.id = np.full((len(least), FIRST), _NO_ID)
        self.need = least.astype(np.int64)  # scores below can't count

    def add(self, asks: slice, score: np.ndarray, ids: np.ndarray, good: np.ndarray) -> None:
        """Rows of ``score`` belong to ``asks``; ``good`` marks what may count."""
        good = good & (score >= self.need[asks][:, None])
        some = np.flatnonzero(good.any(axis=1))
        if not len(some):
            return
        at = asks.start + some
        s = np.concatenate([self.score[at], np.where(good[some], score[some], _LEAST_SCORE)], axis=1)
        i = np.concatenate([self.id[at], np.where(good[some], ids[None, :], _NO_ID)], axis=1)
        if s.shape[1] > 2 * FIRST:  # what is above the score of the last of the first, and all that ties with it
            last = -np.partition(-s, FIRST - 1, axis=1)[:, FIRST - 1]
            keep = int((s >= last[:, None]).sum(axis=1).max())
            if keep < s.shape[1]:
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        order = np.lexsort((i, -s), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.score[at], self.id[at] = s[:, :FIRST], i[:, :FIRST]
        full = self.id[at, -1] != _NO_ID
        self.need[at] = np.where(full, np.maximum(self.need[at], self.score[at, -1]), self.need[at])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ask, id, score) of what was found."""
        ask, at = np.nonzero(self.id != _NO_ID)
        return ask, self.id[ask, at], self.score[ask, at]


def dual_search(anchors: Side, others: Side, asks: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, id, score): for each ask its first candidates with a score in [low, high], of the anchor's label or (``same`` false) of another.

    ``asks`` has the anchor row of each ask, sorted. Node pairs go down both trees at once; a pair
    goes when its interval misses what all asks below the anchor node still need.
    """
    best = Best(low)
    ta, tb = anchors.tree, others.tree
    first, last = np.searchsorted(asks, ta.start), np.searchsorted(asks, ta.end)  # asks below each anchor node
    pairs = np.zeros((1, 2), np.int64)
    leaves: list[np.ndarray] = []
    inner_a, inner_b = (len(ta.start) - 1) // 2, (len(tb.start) - 1) // 2

    def bounds(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = pairs[:, 0], pairs[:, 1]
        return intervals(ta.centre[a], ta.radius[a], tb.centre[b], tb.radius[b])

    def alive(pairs: np.ndarray) -> np.ndarray:
        lo, hi = bounds(pairs)
        own, at = np.unique(pairs[:, 0], return_inverse=True)
        ranges = [(first[k], last[k]) for k in own]
        need = np.array([best.need[s:e].min() if e > s else np.inf for s, e in ranges], float)
        most = np.array([high[s:e].max() if e > s else -np.inf for s, e in ranges], float)
        return (hi >= need[at]) & (lo <= most[at])

    while len(pairs):
        pairs = pairs[alive(pairs)]
        a, b = pairs[:, 0], pairs[:, 1]
        end_a, end_b = a >= inner_a, b >= inner_b
        leaves.append(pairs[end_a & end_b])
        rest, go_a, go_b = pairs[~(end_a & end_b)], ~end_a[~(end_a & end_b)], ~end_b[~(end_a & end_b)]
        kids_a = [np.where(go_a, 2 * rest[:, 0] + k, rest[:, 0]) for k in (1, 2)]
        kids_b = [np.where(go_b, 2 * rest[:, 1] + k, rest[:, 1]) for k in (1, 2)]
        pairs = np.concatenate([np.column_stack([x, y]) for x in kids_a for y in kids_b])
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    every = np.concatenate(leaves)
    if len(every):
        every = every[np.argsort(-bounds(every)[1], kind="stable")]
    for a, b in every:
        s, e = first[a], last[a]
        if e <= s or not alive(np.array([[a, b]]))[0]:
            continue
        part = slice(tb.start[b], tb.end[b])
        here, place = np.unique(asks[s:e], return_inverse=True)
        score = scores(anchors.v[here], others.v[part])[place]
        ids, alike = others.ids[part], anchors.labels[asks[s:e]][:, None] == others.labels[part][None, :]
        good = (alike if same else ~alike) & (ids[None, :] != anchors.ids[asks[s:e]][:, None])
        good &= (score >= low[s:e, None]) & (score <= high[s:e, None])
        best.add(slice(s, e), score, ids, good)
    return best.rows()


PAIRS = "a bigint, b bigint, high double"
FOUND = "anchor_id bigint, ask bigint, other_id bigint, score bigint"


def block_pairs(asks: DataFrame, others: DataFrame, d: int) -> DataFrame:
    """(a, b, high): pairs of anchor blocks and candidate blocks whose interval meets what the asks of the block need.

    Anchor blocks' summaries go in bundles of BUNDLE; a candidate block's summary meets each bundle once.
    """
    n = asks.count()
    bundle = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-n // BUNDLE)))).cast("int")
    ours = asks.groupBy(bundle("block").alias("bundle")).agg(F.collect_list(F.struct("block", "centre", "radius", "low", "high")).alias("ours"))  # of one bundle
    theirs = others.select("block", "centre", "radius", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // BUNDLE)) - 1))).alias("bundle"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b, centre, radius, ours in zip(batch["block"], batch["centre"], batch["radius"], batch["ours"]):
                c = np.frombuffer(b"".join(x["centre"] for x in ours)).reshape(-1, d)
                lo, hi = intervals(c, np.array([x["radius"] for x in ours]), np.frombuffer(centre)[None, :], np.array([radius]))
                good = (hi >= np.array([x["low"] for x in ours], float)) & (lo <= np.array([x["high"] for x in ours], float))
                out += [(ours[k]["block"], b, hi[k]) for k in np.flatnonzero(good)]
            yield pd.DataFrame(out, columns=["a", "b", "high"]).astype({"a": "int64", "b": "int64", "high": "float64"})

    return theirs.join(ours, "bundle").select("block", "centre", "radius", "ours").mapInPandas(compare, PAIRS)


def _asked(asks: DataFrame, anchors: DataFrame, scratch: Scratch) -> DataFrame:
    """Anchor blocks with the asks (anchor_id, ask, low, high) of their anchors, packed, and the widest window of the block."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["anchor_id", "ask"])
        packed = [frame[c].to_numpy(np.int64).tobytes() for c in ("anchor_id", "ask", "low", "high")]
        return pd.DataFrame([(frame["block"].iloc[0], *packed, frame["low"].min(), frame["high"].max())], columns=["block", "of", "ask", "lows", "highs", "low", "high"])

    home = scratch.write(anchors.select("block", "ids").mapInPandas(_unpacked, "block bigint, anchor_id bigint"), "homes")
    packed = asks.join(home, "anchor_id").groupBy("block").applyInPandas(pack, "block bigint, of binary, ask binary, lows binary, highs binary, low bigint, high bigint")
    return scratch.write(packed.join(anchors, "block"), "asks")


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, ids in zip(batch["block"], batch["ids"]):
            yield pd.DataFrame({"block": block, "anchor_id": np.frombuffer(ids, np.int64)})


def _searched(pairs: DataFrame, asks: DataFrame, others: DataFrame, d: int, same: bool, parts: int) -> DataFrame:
    """What the block pairs hold: a row for each ask and candidate that is among the first of its pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a, b = _side(r.ids, r.labels, r.v, d), _side(r.b_ids, r.b_labels, r.b_v, d)
                of, ask, low, high = (np.frombuffer(x, np.int64) for x in (r.of, r.ask, r.lows, r.highs))
                by_id = np.argsort(a.ids)
                at = by_id[np.searchsorted(a.ids, of, sorter=by_id)]
                order = np.argsort(at, kind="stable")
                k, ids, score = dual_search(a, b, at[order], low[order], high[order], same)
                yield pd.DataFrame({"anchor_id": of[order][k], "ask": ask[order][k], "other_id": ids, "score": score})

    # an anchor block that meets many others goes along in several copies, so that no task gets all its pairs
    salt = F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")
    copies = asks.select("block", "ids", "labels", "v", "of", "ask", "lows", "highs", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"))
    ours = pairs.select("a", "b", salt.alias("salt")).join(copies.withColumnRenamed("block", "a"), ["a", "salt"])
    theirs = others.select(F.col("block").alias("b"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("v").alias("b_v"))
    return ours.join(theirs, "b").drop("a", "b", "salt").mapInPandas(run, FOUND)


def _first(found: DataFrame) -> DataFrame:
    """The first FIRST candidates of each ask, with their rank."""
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST)


def search(asks: DataFrame, anchors: DataFrame, others: DataFrame, d: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """(anchor_id, ask, other_id, score, rank): the first candidates of each (anchor_id, ask, low, high), exact.

    The pairs that promise most come first, one for each anchor block; what they give
    bounds the rest.
    """
    packed = _asked(asks, anchors, scratch)
    pairs = scratch.write(block_pairs(packed, others, d), f"{name}-pairs")
    lead = pairs.groupBy("a").agg(F.max_by("b", F.struct("high", "b")).alias("b"))
    found = scratch.write(_first(_searched(lead, packed, others, d, same, 1)), f"{name}-lead")
    full = found.where(F.col("rank") == FIRST).select("anchor_id", "ask", F.col("score").alias("reached"))
    tighter = asks.join(full, ["anchor_id", "ask"], "left").select("anchor_id", "ask", F.greatest("low", F.coalesce("reached", "low")).alias("low"), "high")
    packed = _asked(tighter, anchors, scratch)
    rest = scratch.write(block_pairs(packed, others, d).join(lead, ["a", "b"], "left_anti"), f"{name}-rest")
    most = rest.groupBy("a").count().agg(F.max("count")).first()[0] or 1
    more = _searched(rest, packed, others, d, same, min(1024, -(-most // 4)))
    return scratch.write(_first(found.drop("rank").union(more)), name)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    with Scratch(rows.sparkSession, "hard-negatives") as scratch:
        every = scratch.write(whole(rows, id_col, vec_col, label_col), "whole")
        alike = Window.partitionBy("label", "v").orderBy("vec_id")
        classes = scratch.write(every.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= FIRST + 1).drop("_n"), "classes")
        chosen = scratch.write(every.where(F.col("vec_id") % ANCHOR_EVERY == 0), "chosen")
        d = max(1, classes.agg(F.max(F.size("v"))).first()[0] or 1)
        n, n_anchors = classes.count(), chosen.count()
        sample = np.zeros((min(n, SAMPLE, max(64, SAMPLE_VALUES // d)), d))
        for k, r in enumerate(classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(len(sample)).toLocalIterator()):
            sample[k, : len(r.v)] = r.v
        cuts = splits(sample, n)
        others, anchors = blocks(classes, cuts, d, scratch, "others"), blocks(chosen, cuts.top(n_anchors), d, scratch, "anchors")
        asks = chosen.select(F.col("vec_id").alias("anchor_id"), F.lit(0).cast("long").alias("ask"), F.lit(_LEAST_SCORE).alias("low"), F.lit(-_LEAST_SCORE).alias("high"))
        positives = search(asks, anchors, others, d, True, scratch, "positives")
        # 80 * p <= 100 * n <= 100 * p: below 0 no n does; the ask is the positive
        low = F.expr(f"({LEAST_PERCENT} * score + 99) div 100")
        windows = positives.where("score >= 0").select("anchor_id", F.col("other_id").alias("ask"), low.alias("low"), F.col("score").alias("high"))
        found = search(windows, anchors, others, d, False, scratch, "negatives")
        out = found.join(positives.select("anchor_id", F.col("other_id").alias("ask"), F.col("score").alias("positive_score")), ["anchor_id", "ask"])
        out = out.select("anchor_id", F.col("ask").alias("positive_id"), F.col("rank").cast("int"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return scratch.write(out, "result", keep=True)
