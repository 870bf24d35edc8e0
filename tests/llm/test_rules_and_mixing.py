from __future__ import annotations

import bisect
import collections
import hashlib
import math
import zlib

import pytest
import xxhash

from tests.llm import brute
from vellum.llm import mixing as M, quality_rules as Q, sharding as S
from vellum.sources.scratch import Scratch


def test_base_figures_equal_brute_force(spark):
    rows = brute.edge_rows()
    got = Q.quality_rules(spark.createDataFrame(rows, brute.DOCS)).collect()
    figures = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert figures == collections.Counter((r[0], *brute.base_figures(r[1])) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def test_scores_equal_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(["alpha beta gamma " * 3, "beta beta", "", " ".join(f"q{i}" for i in range(60)), "alpha " + " ".join(f"q{i}" for i in range(70))])]
    with Scratch(spark, "test") as scratch:
        df = spark.createDataFrame(docs, "doc_id long, text string")
        model = Q.train(df, scratch)
    hashes = {k: [xxhash.xxh64_intdigest(w.encode(), 42) for w in t.split()] for k, t in docs}

    def grams(h: list[int]) -> list[int]:
        two = [xxhash.xxh64_intdigest(a.to_bytes(8, "little"), xxhash.xxh64_intdigest(b.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        # Spark hashes the second column with the first column's hash as its seed
        two = [xxhash.xxh64_intdigest(a.to_bytes(8, "little"), xxhash.xxh64_intdigest(b.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [signed(x) % Q.BUCKETS for x in h + two]

    raw, target = collections.Counter(), collections.Counter()
    for k, t in docs:
        g = grams(hashes[k])
        raw.update(g)
        if len(t.split()) >= 50:
            target.update(g)
    n, m = sum(raw.values()) + Q.ADD * Q.BUCKETS, sum(target.values()) + Q.ADD * Q.BUCKETS
    want = [round(1000 * (math.log((target[b] + Q.ADD) / m) - math.log((raw[b] + Q.ADD) / n))) for b in range(Q.BUCKETS)]
    assert model == want
    got = {r.doc_id: r.score for r in Q.scored(df, model).collect()}
    for k, t in docs:
        g = grams(hashes[k])
        assert got[k] == pytest.approx(sum(want[b] for b in g) / max(1, len(g)) / 1000)


def test_quality_stage_keeps_columns(spark):
    docs = spark.createDataFrame(brute.edge_rows(), brute.DOCS)
    got = Q.keep_quality(docs)
    assert got.columns == docs.columns
    want = collections.Counter(r.doc_id for r in Q.quality_rules(docs).collect() if r.kept)
    assert collections.Counter(r.doc_id for r in got.collect()) == want
    assert Q.quality_rules(docs.limit(0)).count() == 0 and Q.keep_quality(docs.limit(0)).count() == 0


def test_stored_map_is_edited(spark):
    """A second run takes the first one's map, keeps it as its former version and moves few slots."""
    docs = [(i, "x" * (10 + i % 50)) for i in range(3000)]
    _, stored = S.shard(spark.createDataFrame(docs, "doc_id long, text string"))
    more = docs + [(i, "y" * 40) for i in range(3000, 3300)]
    rows, table = S.shard(spark.createDataFrame(more, "doc_id long, text string"), stored=stored)
    number, before = S.last_version(stored)
    again, after = S.last_version(table)
    assert (number, again) == (2, 3)
    moved = sum(before[s] != after[s] for s in before)
    assert 0 < moved < 60
    assert {(r.virtual_slot, r.shard) for r in rows.collect()} <= set(after.items())
    sizes = [r["sum(size)"] for r in rows.groupBy("shard").sum("size").collect()]
    assert max(sizes) - min(sizes) <= 60
    with pytest.raises(ValueError, match="slots"):
        S.shard(spark.createDataFrame(more, "doc_id long, text string"), slots=64, stored=stored)


def test_equal_rows_are_numbered_without_gaps(spark):
    rows, _ = S.shard(spark.createDataFrame([(7, "same")] * 500 + [(None, None)] * 300 + [(8, "a"), (9, "b")], "doc_id long, text string"))
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 802


@pytest.mark.parametrize("unit", [1e-7, 1.0, 1e33])
def test_weights_are_in_any_unit(spark, unit):
    docs = spark.createDataFrame([(i, "some text", f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s0", 3 * unit), ("s1", unit)], "source string, weight double")
    rates = {r.source: r.rate for r in M.source_rates(docs, weights).collect()}
    assert rates == {"s0": pytest.approx(1.5), "s1": pytest.approx(0.5)}


def inverse(u: float, mean: float) -> int:
    mass = below = math.exp(-mean)
    k = 0
    while u > below and k < 1000:
        k += 1
        mass *= mean / k
        below += mass
    return k


def drawn(doc_id: int | None, seed: int, part: int) -> float:
    text = f"{seed}:{part}:{'' if doc_id is None else doc_id}"
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def test_mixture_equals_brute_force(spark):
    rows = brute.edge_rows()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode()) + 1
    weights = {"s0": 3.0, "s1": 1.0, None: 1.0}
    df = spark.createDataFrame([(s, w) for s, w in weights.items()], "source string, weight double")
    docs = spark.createDataFrame(rows, brute.DOCS)
    got = collections.Counter(r.row.doc_id for r in M.replicate(docs, df, seed=4).select("row").collect())
    want = collections.Counter()
    for r in rows:
        rate = weights[r[3]] / 5.0 * sum(sizes.values()) / sizes[r[3]]
        parts = max(1, math.ceil(rate / M.PART))
        want[r[0]] += sum(inverse(drawn(r[0], 4, p), rate / parts) for p in range(1, parts + 1))
    assert got == +want
    assert M.mixed(docs, weights=df).columns == docs.columns
    assert M.mixed(docs.limit(0)).count() == 0


def test_mean_count_is_the_rate(spark):
    from pyspark.sql import functions as F

    for mean in (0.3, 2.5, 150.0):
        counts = spark.range(4000).select(M.poisson_count("id", F.lit(mean), 7).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert counts[0] == pytest.approx(mean, rel=0.08) and counts[1] == pytest.approx(mean, rel=0.15)


def test_shards(spark):
    rows = [*brute.edge_rows(), *[(1000 + i, "z" * (i * 37 % 900), "en", "s", 1, "r", 1, "d") for i in range(3000)]]
    got, table = S.shard(spark.createDataFrame(rows, brute.DOCS))
    got = got.collect()
    facts = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert facts == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    total, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(total) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert max(total.values()) - min(total.values()) <= max(r.size for r in got)
    assert {(r.version, r.n) for r in table.groupBy("version").count().withColumnRenamed("count", "n").collect()} == {(1, S.SLOTS), (2, S.SLOTS)}
    assert S.shard(spark.createDataFrame([], brute.DOCS))[0].count() == 0


def test_edits_of_the_map_move_few_slots():
    weight = {s: (s * 7919) % 1000 + 1 for s in range(S.SLOTS)}
    first = S.first_map(S.SLOTS, 8)
    second = S.rebalance(first, weight, 8)
    sums = collections.Counter()
    for s, k in second.items():
        sums[k] += weight[s]
    assert max(sums.values()) - min(sums.values()) <= 2
    assert sum(first[s] != second[s] for s in first) < S.SLOTS // 20
    third = S.grow(second, weight, 8)
    assert all(third[s] in (second[s], 8) for s in second)
    assert abs(sum(weight[s] for s in third if third[s] == 8) - sum(weight.values()) / 9) < 1000


def test_shards_stay_even_where_an_id_holds_a_third_of_the_rows(spark):
    rows = [(7, "one text that repeats")] * 2000 + [(7, f"text {i % 50} of the same id") for i in range(1000)] + [(1000 + i, "x" * (i % 60)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, table = S.shard(docs)
    held = got.collect()
    assert len(held) == len(rows)
    size = collections.Counter()
    for r in held:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8
    for k in range(8):
        assert sorted(r.slot for r in held if r.shard == k) == list(range(sum(r.shard == k for r in held)))
    assert sum(r.size for r in held) == sum(len(t) + 1 for _, t in rows)
    again = S.shard(docs, stored=table)[0]
    assert again.count() == len(rows)
