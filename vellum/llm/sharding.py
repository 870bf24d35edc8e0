"""Sharding by fixed virtual slots.

A record's id hashes into one of thousands of virtual slots. A slot that holds more than
:data:`HOT` of a shard's share in many rows, as an id that repeats may, is hot: its rows hash with
their text's CRC and their place instead, so they spread over all slots. Bytes and rows are
summed by slot, and a versioned map says which shard holds which slot. Version 1
deals the slots out in turn; each rebalancing edits the newest version, this run's
or a stored one, into the next by moving the fewest slots that bring the shards'
bytes together, so the law is ``bytes``: sizes near equal. The map has at most :data:`SLOTS` rows a version, whatever the
input, so the driver may hold it and a join may broadcast it.

Defined results: a null text has 0 bytes and the CRC of the empty text, and its
size is 1; a null id hashes as the empty text; repeated rows each get a place.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.sources.scratch import Scratch

#: Virtual slots: fixed for the life of a dataset, far above any number of shards. Parts of a slot that are numbered apart.
SLOTS, PARTS = 8192, 8
#: Share of a shard's bytes, and rows, from which a slot is hot.
HOT, HOT_ROWS = 1 / 32, 16


def virtual_slot(id_col: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> dict[int, int]:
    """Version 1: slot s in shard s mod shards."""
    return {s: s % shards for s in range(slots)}


def rebalance(held: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited: slots leave the fullest shard for the emptiest while that brings the two closer."""
    new = dict(held)
    total = [0] * shards
    slots: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, shard in held.items():
        if w := weight.get(s, 0):
            total[shard] += w
            slots[shard].append((w, s))
    for x in slots:
        x.sort()
    for _ in range(4 * len(held)):
        full, empty = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
        gap = total[full] - total[empty]
        at = _at_most(slots[full], gap // 2)
        if at is None:
            break
        w, s = slots[full].pop(at)
        new[s] = empty
        total[full] -= w
        total[empty] += w
        slots[empty].append((w, s))
        slots[empty].sort()
    return new


def _at_most(slots: list[tuple[int, int]], most: int) -> int | None:
    """Where the heaviest slot of weight ``most`` or less is, in a sorted list."""
    import bisect

    at = bisect.bisect_right(slots, (most, 1 << 62)) - 1
    return at if at >= 0 and slots[at][0] > 0 else None


def grow(held: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """The map with one more shard: slots leave only for the new shard, from whichever shard is then fullest."""
    new = dict(held)
    total = [0] * shards
    slots: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, shard in held.items():
        total[shard] += weight.get(s, 0)
        slots[shard].append((weight.get(s, 0), s))
    heap = [(-t, k) for k, t in enumerate(total)]
    heapq.heapify(heap)
    for x in slots:
        x.sort()
    fair, taken = sum(total) / (shards + 1), 0
    while heap and taken < fair:
        t, k = heapq.heappop(heap)
        at = _at_most(slots[k], int(fair - taken))
        if at is None or -t <= fair:
            continue
        w, s = slots[k].pop(at)
        new[s] = shards
        taken += w
        heapq.heappush(heap, (t + w, k))
    return new


def hot_slots(sums: list, shards: int) -> list[int]:
    """Slots of (virtual_slot, bytes, rows) ``sums`` that are hot."""
    size, rows = Counter(), Counter()
    for r in sums:
        size[r.virtual_slot] += r.bytes
        rows[r.virtual_slot] += r.rows
    most = sum(size.values()) / shards * HOT
    return sorted(s for s in size if size[s] > most and rows[s] >= HOT_ROWS)


def last_version(table: DataFrame) -> tuple[int, dict[int, int]]:
    """(version, virtual slot -> shard) of the newest version in a stored map."""
    newest = table.agg(F.max("version")).first()[0]
    return newest, {r.virtual_slot: r.shard for r in table.where(F.col("version") == newest).collect()}  # a row for each slot


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, map).

    ``stored`` is the map that an earlier run returned: its newest version is edited
    into the next one, so that only the slots that the new sizes ask for move.
    Without it version 1 deals the slots out in turn. A stored map has to have the
    same number of slots, and shards under ``shards``.

    rows: a row for each row of ``docs``: doc_id, size, text_crc32, law, shard,
    slot (place in the shard, gapless from 0), grown_shard (null under the law
    ``bytes``), virtual_slot, map_version. map: version, virtual_slot, shard,
    bytes, rows, first_place.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    facts = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), virtual_slot(id_col, slots).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("salt"),  # parts rows that are alike in all; the table written keeps it as it is
    )
    own = F.xxhash64("doc_id", "text_crc32", "size", "salt")
    facts = facts.select("*", F.pmod(own, F.lit(PARTS)).cast("int").alias("part"), F.pmod(F.xxhash64(own), F.lit(slots)).cast("int").alias("spread")).drop("salt")
    with Scratch(spark, "sharding") as scratch:
        facts = scratch.write(facts, "facts", keep=True)
        sums = lambda t: t.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # noqa: E731  at most ``slots`` * PARTS rows
        held = sums(facts)
        if hot := hot_slots(held, shards):
            facts = facts.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), F.col("spread")).otherwise(F.col("virtual_slot")))
            held = sums(facts)
        weight, count, parts = Counter(), Counter(), {}
        for r in held:
            weight[r.virtual_slot] += r.bytes
            count[r.virtual_slot] += r.rows
            parts[r.virtual_slot, r.part] = r.rows
        if stored is None:
            versions = {1: first_map(slots, shards)}
        else:
            number, held = last_version(stored)
            if len(held) != slots or max(held.values()) >= shards:
                raise ValueError(f"the stored map has {len(held)} slots and shards up to {max(held.values())}")
            versions = {number: held}
        newest = max(versions) + 1
        versions[newest] = rebalance(versions[newest - 1], weight, shards)
        lines = []
        for version, held in versions.items():
            place = [0] * shards
            for s in range(slots):
                lines.append((version, s, held[s], weight.get(s, 0), count.get(s, 0), place[held[s]]))
                place[held[s]] += count.get(s, 0)
        table = spark.createDataFrame(lines, "version int, virtual_slot int, shard int, bytes long, rows long, first_place long")
        table = scratch.write(table.coalesce(1), "map", keep=True)
        starts = []
        first = {s: start for version, s, _, _, _, start in lines if version == newest}
        for (s, part), n in sorted(parts.items()):
            starts.append((s, part, versions[newest][s], first[s]))
            first[s] += n
        now = scratch.write(spark.createDataFrame(starts, "virtual_slot int, part int, shard int, first_place long").coalesce(1), "places", keep=True)
    # a slot is numbered in parts
    within = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    rows = facts.withColumn("within", within).join(F.broadcast(now), ["virtual_slot", "part"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_place") + F.col("within") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(newest).alias("map_version"),
    ), table
