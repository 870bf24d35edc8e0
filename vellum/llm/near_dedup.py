"""MinHash near-dedup by tensored banding.

A text's words (A-Z lower-cased) give a set of shingles, hashed to 64 bits. Two
small collections of :data:`SIDE` half keys, each of :data:`DEPTH` minimum hashes,
stand for SIDE * SIDE tables: table (i, j) is keyed by half key i of the first
collection with half key j of the second. Minimum hashes worked out:
2 * SIDE * DEPTH, about a square root of what as many independent tables take.

1. Texts with equal sets form a class; classes are what follows works on.
2. A half key that no other class has can't be part of a shared table key, so only
   the product of a class's shared halves is spelled out.
3. Each table's bucket links its members to its least one; links are confirmed on
   the full sets and joined into components.
4. Where the members of a half key's bucket still lie in different components, each
   member outside its largest component is compared with the others in blocks, each
   pair once: signatures first, then sets, of which a block has each once. No pair that
   shares a table and could join components is left out, and no pairs are spelled out but
   links that join components and, of sets above :data:`SKETCH`, those too near the
   limit to tell by that many hashes.

At a similarity of 0.8 two texts share a table with a probability of 0.9999; above
it the miss fades quickly.

Defined results: a null text counts as empty; texts without words link with
nothing and stay, repeated or not; rows that share an id are one document; a row
with a null id has a null component and stays; of rows that repeat an id and a set
one is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vellum.llm.rows import at_task_end, end_task, map_texts, picked, small_batches
from vellum.operators.graph import connected_components
from vellum.sources.scratch import Scratch

#: Half keys of each collection; minimum hashes of a half key.
SIDE, DEPTH = 14, 3
#: Words of a shingle; percentage of the union that the intersection must reach.
WORDS, PERCENT = 5, 80
#: Share of equal minimum hashes below which a pair goes no further: five standard deviations under 0.8 for 84 hashes.
LEAST_EQUAL = 0.58
#: Members of a block in the comparison of a bucket's rest; least hashes of a set that it compares, and the share of
#: equal ones below which a longer pair goes no further: five standard deviations under 0.8.
BLOCK, SKETCH, LEAST_SKETCHED = 1024, 4096, 0.77

#: Bytes of sketches from which a block counts as large.
LARGE_BLOCK = 1 << 20

_random = np.random.Generator(np.random.PCG64(20240229))
_MUL = _random.integers(1, 1 << 63, size=2 * SIDE * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, size=2 * SIDE * DEPTH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words seen; emptied when it grows past a quarter of a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()
at_task_end(_hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words, of the whole sequence; without words, none."""
    found = text.lower().split()  # bytes: lowers A-Z only and splits at \\x20 and \\x09 to \\x0D
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    mixed = _mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        mixed = _mixed(mixed * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(mixed)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The 2 * SIDE * DEPTH minimum hashes of a set."""
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, (np.multiply.outer(_MUL, part) + _ADD[:, None]).min(axis=1), out=least)
    return least


def half_keys(least: np.ndarray) -> np.ndarray:
    """The 2 * SIDE half keys: the first SIDE are collection one."""
    parts = least.reshape(2 * SIDE, DEPTH)
    key = _mixed(parts[:, 0] + np.arange(1, 2 * SIDE + 1, dtype=np.uint64))
    for k in range(1, DEPTH):
        key = _mixed(key * _MIX + parts[:, k])
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash, for estimates."""
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def digest_of(shingles: np.ndarray) -> bytes | None:
    """What stands for a set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


PROFILES = "doc_id bigint, n_shingles bigint, digest binary, halves array<bigint>, signature binary"


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """n_shingles, digest of the set, half keys and signature of each (doc_id, text)."""

    def each(ids: list, texts: list[bytes]) -> dict[str, object]:
        sizes, digests, halves, signatures = [], [], [], []
        for text in texts:
            s = shingle_set(text, words)
            sizes.append(len(s))
            digests.append(digest_of(s))
            if len(s):
                least = minhashes(s)
                halves.append(half_keys(least))
                signatures.append(signature(least).tobytes())
            else:
                halves.append(None), signatures.append(None)
        return {"doc_id": ids, "n_shingles": sizes, "digest": digests, "halves": halves, "signature": signatures}

    return map_texts(docs, PROFILES, each)


def _table_keys(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node): the table keys of each class, spelled out from the halves that another class has too."""
    halves = classes.select("node", F.posexplode("halves").alias("at", "half"))
    shared = scratch.write(halves.groupBy("at", "half").agg(F.count("*").alias("n")).where("n > 1").select("at", "half"), "shared")
    alive = halves.join(shared, ["at", "half"], "left_semi").groupBy("node").agg(F.collect_list(F.struct("at", "half")).alias("alive"))
    first, second = (F.filter("alive", f) for f in (lambda x: x["at"] < SIDE, lambda x: x["at"] >= SIDE))
    pairs = alive.select("node", F.explode(first).alias("a"), second.alias("second")).select("node", "a", F.explode("second").alias("b"))
    return pairs.select(F.xxhash64("a.at", "a.half", "b.at", "b.half").alias("key"), "node")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v) of those (u, v) ``pairs`` whose full sets are alike enough: signatures and sizes first, then the sets from the texts."""
    marks = classes.select("node", "n_shingles", "signature")
    near = pairs
    for side in ("u", "v"):
        near = near.join(marks.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}")), side)
    near = near.where((100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).mean(axis=1) >= LEAST_EQUAL)

    near = scratch.write(near.where(alike("s_u", "s_v")).select("u", "v").distinct(), "near")
    wanted = scratch.write(near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct(), "wanted")
    texts = docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi")

    def each(ids: list, texts: list[bytes]) -> dict[str, object]:
        return {"node": ids, "shingles": [shingle_set(t, words).tobytes() for t in texts]}

    sets = scratch.write(map_texts(texts, "node bigint, shingles binary", each), "sets")
    both = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("of_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("of_v")), "v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):  # a pair at a time, without copies of the batch
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * n >= percent * (len(x) + len(y) - n))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])
        end_task()

    small_batches(docs.sparkSession)
    links = scratch.write(both.select("u", "v", "of_u", "of_v").mapInArrow(confirm, "u bigint, v bigint"), "links")
    for used in (sets, wanted, near):
        scratch.release(used)
    return links


def _alike_share(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity estimated from the SKETCH least hashes of two sets."""
    both = np.union1d(x, y)[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean())


def _compared(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links and possible links of one block of a bucket of half key ``at``: those that ask against the others.

    A pair of two that ask stands in two blocks: that where the smaller node asks has it.
    Each link found joins two components of the block, and what they hold is not compared again.
    """
    asks = frame["asks"].to_numpy()
    left, right = frame[asks], frame[~asks]
    us, vs, sures = [], [], []
    if len(left) and len(right):
        at = int(frame["at"].iloc[0])
        x, y = (np.frombuffer(b"".join(f["signature"]), np.uint16).reshape(len(f), -1) for f in (left, right))
        of_x, of_y = ([np.frombuffer(v, np.uint64) for v in f["sketch"]] for f in (left, right))
        (cx, nx, mx), (cy, ny, my) = ((f["component"].to_numpy().copy(), f["node"].to_numpy(), f["n_shingles"].to_numpy()) for f in (left, right))
        outside = right["outside"].to_numpy()
        codes: list[np.ndarray] = []
        for k in range(len(x)):
            near = np.flatnonzero((cy != cx[k]) & (~outside | (nx[k] < ny)) & (100 * np.minimum(mx[k], my) >= percent * np.maximum(mx[k], my)))
            equal = y[near] == x[k]
            whole = equal.reshape(len(near), 2, SIDE, DEPTH).all(axis=3)
            # the two share a table, and this is the first half key that they share
            near = near[(equal.mean(axis=1) >= LEAST_EQUAL) & whole[:, 1].any(axis=1) & (whole[:, 0].argmax(axis=1) == at)]
            if not len(near):
                continue
            if not codes:  # places of all hashes of the block, to mark those of one set
                places, code = np.unique(np.concatenate(of_x + of_y), return_inverse=True)
                codes = np.split(code, np.cumsum([len(v) for v in of_x + of_y])[:-1])
                marked = np.zeros(len(places), bool)
            marked[codes[k]] = True
            for j in near.tolist():
                if cy[j] == cx[k]:
                    continue
                sure = mx[k] <= SKETCH and my[j] <= SKETCH
                if sure:
                    common = np.count_nonzero(marked[codes[len(x) + j]])
                    good = 100 * common >= percent * (mx[k] + my[j] - common)
                else:
                    good = _alike_share(of_x[k], of_y[j]) >= LEAST_SKETCHED
                if good:
                    us.append(nx[k]), vs.append(ny[j]), sures.append(sure)
                if good and sure:
                    gone, stays = cy[j], cx[k]
                    cx[cx == gone] = stays
                    cy[cy == gone] = stays
            marked[codes[k]] = False
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64), "sure": np.array(sures, bool)})


def _compared_block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """:func:`_compared`, giving memory back after a block of many or long sets."""
    out = _compared(frame, percent)
    if len(frame) >= BLOCK // 8 or frame["sketch"].str.len().sum() > LARGE_BLOCK:
        end_task()
    return out


def _rest(nodes: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v, sure) across components: in each bucket of a half key that holds several, the members outside its largest component against all others.

    Texts that share a table share its first half, so buckets of single half keys
    bring together all pairs that a table does, in SIDE rows a class instead of
    SIDE * SIDE. Blocks are compared in numpy and give no more links than join
    components; sets of SKETCH hashes or fewer are compared whole, longer ones by
    their least hashes, and what passes for them is confirmed on full sets.
    """
    held = classes.join(nodes, "node", "left_semi").join(labels, "node", "left")
    placed = held.select("node", "digest", F.coalesce("component", "node").alias("component"), F.posexplode(F.slice("halves", 1, SIDE)).alias("at", "half"))
    placed = scratch.write(placed, "placed")
    parts = placed.groupBy("at", "half", "component").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("at", "half").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = buckets.select("at", "half", F.col("most.component").alias("main"), blocks(F.col("n")).alias("b_all"), blocks(F.greatest(F.col("n") - F.col("most.n"), F.lit(1))).alias("b_out"))
    plan = scratch.write(plan, "plan")
    open_rows = scratch.write(placed.join(plan, ["at", "half"]), "open")
    wanted = scratch.write(open_rows.select("node").distinct(), "open-nodes")

    def each(ids: list, texts: list[bytes]) -> dict[str, object]:
        sets = [shingle_set(t, words) for t in texts]
        return {"node": ids, "digest": [digest_of(s) for s in sets], "sketch": [s[:SKETCH].tobytes() for s in sets]}

    sketches = map_texts(docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi"), "node bigint, digest binary, sketch binary", each)
    facts = scratch.write(sketches.join(classes.select("node", "digest", "n_shingles", "signature"), ["node", "digest"]), "facts")
    full = open_rows.join(facts, ["node", "digest"])
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    common = ("at", "half", "node", "component", "n_shingles", "signature", "sketch")
    asked = full.where("component <> main").select(*common, F.lit(True).alias("asks"), F.lit(True).alias("outside"), spot(F.col("b_out")).alias("p"), F.explode(F.sequence(F.lit(0), F.col("b_all") - 1)).alias("q"))
    others = full.select(*common, F.lit(False).alias("asks"), (F.col("component") != F.col("main")).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("b_out") - 1)).alias("p"), spot(F.col("b_all")).alias("q"))
    found = asked.union(others).groupBy("at", "half", "p", "q").applyInPandas(lambda f: _compared_block(f, percent), "u bigint, v bigint, sure boolean")
    ordered = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sure").where("u < v")
    out = scratch.write(ordered.distinct(), "rest")
    for used in (placed, plan, open_rows, facts):
        scratch.release(used)
    return out


def near_groups(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n, n_shingles, component_id): a row for each distinct id and set, n rows of which there are."""
    texts = picked(docs, id_col, text_col)
    whole = scratch.write(profiles(texts, words), "profiles")
    pairs = scratch.write(whole.groupBy("digest", "doc_id", "n_shingles").agg(F.count("*").alias("n")), "pairs", keep=True)
    named = pairs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = scratch.write(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    # rows that repeat a class's least id and set give the same profile; an id with several sets is the node of several classes
    reps = whole.join(nodes, (whole.digest == nodes.digest) & (whole.doc_id == nodes.node), "left_semi").select(F.col("doc_id").alias("node"), "digest", "n_shingles", "halves", "signature")
    classes = scratch.write(reps.dropDuplicates(["node", "digest"]), "classes")
    scratch.release(whole)

    keys = _table_keys(classes, scratch)
    keys = scratch.write(keys, "keys")
    least = scratch.write(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least"), "least")
    kept = scratch.write(keys.join(least, "key").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(), "star")
    scratch.release(keys)
    star = kept.where("u <> v")
    links = _confirmed(star, classes, texts, words, percent, scratch)
    # rows that share an id are one document
    same = named.groupBy("digest").agg(F.min("doc_id").alias("u")).join(named.select("digest", F.col("doc_id").alias("v")), "digest").select("u", "v").where("u <> v")
    labels = scratch.write(connected_components(links, scratch), "labels")
    rest = _rest(kept.select(F.col("v").alias("node")).distinct(), labels, classes, texts, words, percent, scratch)
    more = _confirmed(rest.where("NOT sure").select("u", "v"), classes, texts, words, percent, scratch)
    every = links.union(rest.where("sure").select("u", "v")).union(more).union(same)
    final = scratch.write(connected_components(every, scratch), "components", keep=True)
    return pairs.join(final, pairs.doc_id == final.node, "left").select("doc_id", "digest", "n", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    with Scratch(docs.sparkSession, "near-dedup") as scratch:
        groups = near_groups(docs, scratch, words, percent, id_col, text_col)
    each = groups.select("*", F.posexplode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("at", "_"))
    first = (F.col("at") == 0) | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return each.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & first).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, those rows that :func:`near_dedup` keeps; of rows that repeat an id and a set that with the least JSON form stays."""
    with Scratch(docs.sparkSession, "near-dedup") as scratch:
        groups = near_groups(docs, scratch, words, percent, id_col, text_col)
        gone = scratch.write(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct(), "gone", keep=True)
        repeated = scratch.write(groups.where("n > 1 AND n_shingles > 0 AND doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct(), "repeated", keep=True)
        any_repeated = repeated.limit(1).count() > 0
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_of"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept = marked.join(gone, F.col("_of") == F.col("_gone"), "left_anti")
    if not any_repeated:
        return kept.select("row.*")

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([digest_of(shingle_set(t.encode(), words)) for t in texts], dtype="object")

    again = kept.join(repeated, F.col("_of") == F.col("_id"), "left_semi").select("row", "_of", digest("_text").alias("_digest"))
    first = again.where("_digest IS NOT NULL").groupBy("_of", "_digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    rest = kept.join(repeated, F.col("_of") == F.col("_id"), "left_anti").select("row")
    return rest.union(first).union(again.where("_digest IS NULL").select("row")).select("row.*")  # rows without words all stay
