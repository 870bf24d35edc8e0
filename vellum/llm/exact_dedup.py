"""Exact dedup on a cuckoo-filter index of live digests.

Every text becomes the SHA-256 of its A-Z lower-cased UTF-8, by built-in
functions. The index deals digests into buckets; a bucket is one row with a cuckoo
filter and the stored keys: the whole digest that stands for the content, the id
that stays and the number of rows. Partial counts reach a bucket one after another, and the bucket
decides: a digest that the filter lacks is new; one that the filter has is
verified against the bucket's stored keys, so the filter's false positives change
no result, and joins the entry that it hits. When an insertion finds no free slot,
the table doubles and is filled again from the stored keys. A side table has the
ids of each digest with their counts: a deletion takes rows out of it and chooses
the id that stays anew; digests whose last row goes leave filter and keys.

A digest's rows are counted by :data:`PARTS` hashes of the id before they are
dealt, so a text that a third of all rows share sends its bucket PARTS rows at
most.

Defined results: a null text counts as empty, and all empty texts are equal; a
null id is smaller than any other; of rows that repeat an id and a text one stays,
in the pipeline's stage that with the least JSON form; deleting rows that are not
there changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.rows import lowered, picked
from vellum.sources.scratch import Scratch

#: Stored keys that a bucket is laid out for, slots of a cell, moves before the table doubles, partial counts of a digest.
KEYS_PER_BUCKET, CELL, MOVES, PARTS = 20_000, 4, 200, 16


class CuckooFilter:
    """Fingerprints of 16 bits in cells of four slots; partial-key cuckoo hashing."""

    def __init__(self, cells: int = 64, table: np.ndarray | None = None) -> None:
        self.table = np.zeros((cells, CELL), np.uint16) if table is None else table

    @property
    def cells(self) -> int:
        return len(self.table)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") % self.cells
        return mark, first, self._other(first, mark)

    def _other(self, cell: int, mark: int) -> int:
        return cell ^ ((mark * 0x5BD1E995) % self.cells)  # cells is a power of two, so this is its own inverse

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())

    def insert(self, key: bytes) -> bool:
        """False if no slot was found; the table then lacks one fingerprint and must be refilled."""
        mark, a, b = self._places(key)
        for cell in (a, b):
            free = np.flatnonzero(self.table[cell] == 0)
            if len(free):
                self.table[cell, free[0]] = mark
                return True
        cell = b
        for move in range(MOVES):
            slot = (mark + move) % CELL
            mark, self.table[cell, slot] = int(self.table[cell, slot]), mark
            cell = self._other(cell, mark)
            free = np.flatnonzero(self.table[cell] == 0)
            if len(free):
                self.table[cell, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for cell in (a, b):
            at = np.flatnonzero(self.table[cell] == mark)
            if len(at):
                self.table[cell, at[0]] = 0
                return True
        return False


class Bucket:
    """A cuckoo filter in front of stored keys."""

    def __init__(self, keys: dict[bytes, list] | None = None, table: np.ndarray | None = None) -> None:
        self.keys: dict[bytes, list] = keys or {}
        self.filter = CuckooFilter(64, table)

    def find(self, key: bytes) -> list | None:
        """[id that stays, rows] of a live digest: the filter first, then the stored keys."""
        return self.keys.get(key) if key in self.filter else None

    def add(self, key: bytes, doc_id: int | None, rows: int) -> None:
        """A partial count: new if the filter or the stored keys lack it, else joined to the entry it hits."""
        held = self.find(key)
        if held is None:
            self.keys[key] = [doc_id, rows]
            if not self.filter.insert(key):
                self._grow()
        else:
            held[0] = max((x for x in (held[0], doc_id) if x is not None), default=None)
            held[1] += rows

    def put(self, key: bytes, doc_id: int | None, rows: int) -> None:
        """What is left of a digest after a deletion; without rows it leaves keys and filter."""
        held = self.find(key)
        if held is not None:
            held[:] = doc_id, rows
            if rows <= 0:
                del self.keys[key]
                self.filter.delete(key)

    def _grow(self) -> None:
        cells = self.filter.cells
        while True:
            cells *= 2
            self.filter = CuckooFilter(cells)
            if all(self.filter.insert(k) for k in self.keys):
                return


def digest_of(text_col: str) -> Column:
    """Lower-case hex SHA-256 of a text's normal form, never null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(F.sha2(lowered(text).cast("binary"), 256), F.lit(""))  # a column that may be null would be worked out again to filter nulls


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of each row."""
    return picked(docs, id_col, text_col).select("doc_id", digest_of("text").alias("digest"))


INDEX = "bucket int, cells int, filter binary, keys array<struct<digest:string,keep_id:bigint,rows:bigint>>"


def _bucket(n: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def _stored(frame: pd.DataFrame) -> Bucket:
    if not len(frame):
        return Bucket()
    row = frame.iloc[0]
    keys = {bytes.fromhex(k["digest"]): [k["keep_id"], k["rows"]] for k in row["keys"]}
    return Bucket(keys, np.frombuffer(row["filter"], np.uint16).reshape(-1, CELL).copy())


def _row(bucket: int, held: Bucket) -> pd.DataFrame:
    keys = [{"digest": k.hex(), "keep_id": v[0], "rows": v[1]} for k, v in held.keys.items()]
    return pd.DataFrame({"bucket": [bucket], "cells": [held.filter.cells], "filter": [held.filter.table.tobytes()], "keys": [keys]})


class CuckooIndex:
    """A table of buckets, each written whole by the task that changed it, and the table of the ids that they hold.

    ``frame`` has a row for each bucket, ``ids`` (digest, doc_id, n) a row for each
    id of a digest. :meth:`insert` and :meth:`delete` return a new index; the old one
    stays valid until its files go.
    """

    def __init__(self, frame: DataFrame | None, ids: DataFrame | None, buckets: int, scratch: Scratch) -> None:
        self.frame, self.ids, self.buckets, self.scratch = frame, ids, buckets, scratch

    def _changed(self, changes: DataFrame, ids: DataFrame, change: str) -> CuckooIndex:
        """``changes``: (digest, doc_id, rows), given to ``change`` of their buckets one after another."""
        dealt = changes.select(_bucket(self.buckets), "digest", "doc_id", "rows")

        def apply(held: Bucket, frame: pd.DataFrame) -> Bucket:
            each = getattr(held, change)
            for digest, doc_id, rows in zip(frame["digest"], frame["doc_id"].astype(object), frame["rows"]):
                each(bytes.fromhex(digest), None if pd.isna(doc_id) else int(doc_id), int(rows))
            return held

        def fresh(frame: pd.DataFrame) -> pd.DataFrame:
            return _row(int(frame["bucket"].iloc[0]), apply(Bucket(), frame))

        def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            return _row(int((old if len(old) else new)["bucket"].iloc[0]), apply(_stored(old), new))

        if self.frame is None:
            made = dealt.groupBy("bucket").applyInPandas(fresh, INDEX)
        else:
            made = self.frame.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(merge, INDEX)
        return CuckooIndex(self.scratch.write(made, "index"), ids, self.buckets, self.scratch)

    def insert(self, rows: DataFrame) -> CuckooIndex:
        """Add (digest, doc_id) rows."""
        return self.insert_counted(counted(rows, self.scratch))

    def insert_counted(self, new: DataFrame) -> CuckooIndex:
        """Add (digest, doc_id, n), a row for each id of a digest."""
        ids = new if self.ids is None else self.scratch.write(self.ids.union(new).groupBy("digest", "doc_id").agg(F.sum("n").alias("n")), "ids", keep=True)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        partial = new.groupBy("digest", part.alias("part")).agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("rows"))
        return self._changed(partial, ids, "add")

    def delete(self, rows: DataFrame) -> CuckooIndex:
        """Take out (digest, doc_id) rows; of a digest that lives on the id that stays is chosen anew."""
        gone = self.scratch.write(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("m")), "gone")
        mine = gone.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc_id"), "m")
        joined = self.ids.join(mine, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
        left = joined.select("digest", "doc_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
        ids = self.scratch.write(left, "ids", keep=True)
        touched = gone.select("digest").distinct()
        rest = ids.join(touched, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("rows"))
        changes = touched.join(rest, "digest", "left").select("digest", "doc_id", F.coalesce("rows", F.lit(0)).alias("rows"))
        return self._changed(changes, ids, "put")

    def live(self) -> DataFrame:
        """(digest, keep_id, group_size) of the live digests."""
        return self.frame.select(F.explode("keys").alias("k")).select("k.digest", "k.keep_id", F.col("k.rows").alias("group_size"))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size) for those of the distinct ``rows.digest`` that are live."""
        asked = rows.select("digest").distinct().select(_bucket(self.buckets), "digest")

        def probe(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            held = _stored(old)
            found = [(d, *hit) for d in new["digest"] if (hit := held.find(bytes.fromhex(d))) is not None]
            return pd.DataFrame(found, columns=["digest", "keep_id", "group_size"], dtype=object)

        out = "digest string, keep_id bigint, group_size bigint"
        return self.frame.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(probe, out)


def counted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, doc_id, n), a row for each distinct id and digest, written."""
    return scratch.write(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "ids", keep=True)


def build_index(ids: DataFrame, scratch: Scratch, keys_per_bucket: int = KEYS_PER_BUCKET) -> CuckooIndex:
    """An index of (digest, doc_id, n) rows, with as many buckets as they need."""
    n = max(1, -(-ids.count() // keys_per_bucket))
    shuffles = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return CuckooIndex(None, None, max(n, 2 * shuffles), scratch).insert_counted(ids)


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n, keep_id, group_size): a row for each distinct id and text, n rows of which there are."""
    index = build_index(counted(digests(docs, id_col, text_col), scratch), scratch)
    live = scratch.write(index.live(), "live", keep=True)
    return index.ids.join(live, "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    with Scratch(docs.sparkSession, "exact-dedup") as scratch:
        groups = exact_groups(docs, scratch, id_col, text_col)
    return groups.select(
        "doc_id", "keep_id", "group_size",
        F.posexplode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("at", "_"), "digest",
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == 0)).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row for each text."""
    with Scratch(docs.sparkSession, "exact-dedup") as scratch:
        groups = exact_groups(docs, scratch, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        stay = scratch.write(groups.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n").alias("_n")), "stay", keep=True)
        repeats = stay.where("_n > 1").limit(1).count() > 0
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_of"), digest_of(text_col).alias("_text"))
    kept = marked.join(stay, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest")))
    once = kept.where("_n = 1").select("row") if repeats else kept.select("row")
    if repeats:  # only the rows that repeat an id and a text are shuffled whole
        once = once.union(kept.where("_n > 1").groupBy("_of", "_text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return once.select("row.*")
