from __future__ import annotations

import collections
import random

import numpy as np

from tests.llm import brute
from vellum.llm import exact_dedup as E, near_dedup as N
from vellum.sources.scratch import Scratch


def test_exact_groups_equal_brute_force(spark):
    rows = brute.edge_rows()
    got = E.exact_dedup(spark.createDataFrame(rows, brute.DOCS)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute.exact(rows)


def test_exact_stage_keeps_one_whole_row_of_each_text(spark):
    rows = brute.edge_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    got = E.drop_exact_copies(docs)
    assert got.columns == docs.columns
    want = sorted((k[0] is None, k[0] or 0, k[4]) for k in brute.exact(rows) if k[3])
    import hashlib

    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(brute.lowered(r.text)).hexdigest()) for r in got.collect()) == want


def test_exact_of_no_rows(spark):
    empty = spark.createDataFrame([], brute.DOCS)
    assert E.exact_dedup(empty).count() == 0
    assert E.drop_exact_copies(empty).count() == 0


def test_cuckoo_filter_has_what_it_was_given_and_loses_what_it_is_told_to():
    r = random.Random(3)
    keys = [r.randbytes(32) for _ in range(3000)]
    held = E.Bucket()
    for k, key in enumerate(keys):
        held.add(key, k, 1)
    assert all(held.find(k) == [i, 1] for i, k in enumerate(keys))
    assert held.filter.cells > 64  # it grew from the stored keys
    wrong = sum(r.randbytes(32) in held.filter for _ in range(5000))
    assert wrong < 25
    for key in keys[::2]:
        held.put(key, None, 0)
    assert all(held.find(k) is None for k in keys[::2]) and all(held.find(k) for k in keys[1::2])


def test_index_inserts_looks_up_and_deletes(spark):
    with Scratch(spark, "test") as scratch:
        first = E.digests(spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string"))
        index = E.CuckooIndex(None, None, 4, scratch).insert(first)
        more = index.insert(E.digests(spark.createDataFrame([(9, "a"), (4, "c")], "doc_id long, text string")))
        live = {(r.keep_id, r.group_size) for r in more.live().collect()}
        assert live == {(9, 3), (3, 1), (4, 1)}
        gone = more.delete(E.digests(spark.createDataFrame([(8, "B")], "doc_id long, text string")))
        asked = E.digests(spark.createDataFrame([(0, "b"), (0, "c"), (0, "zzz")], "doc_id long, text string"))
        assert sorted((r.keep_id, r.group_size) for r in gone.lookup(asked).collect()) == [(3, 1), (4, 1)]  # there was no row 8 of b
        gone = gone.delete(E.digests(spark.createDataFrame([(3, "B"), (7, "B")], "doc_id long, text string")))
        assert [(r.keep_id, r.group_size) for r in gone.lookup(asked).collect()] == [(4, 1)]


def test_deletion_chooses_the_row_that_stays_anew(spark):
    docs = lambda *rows: E.digests(spark.createDataFrame(list(rows), "doc_id long, text string"))
    with Scratch(spark, "test") as scratch:
        index = E.CuckooIndex(None, None, 4, scratch).insert(docs((1, "a"), (2, "A"), (9, "a"), (9, "a"), (None, "b"), (3, "b")))
        now = lambda i: sorted((r.keep_id is not None, r.keep_id, r.group_size) for r in i.live().collect())
        assert now(index) == [(True, 3, 2), (True, 9, 4)]
        index = index.delete(docs((9, "A"), (3, "b")))
        assert now(index) == [(False, None, 1), (True, 9, 3)]
        index = index.delete(docs((9, "A"), (None, "b"), (5, "zzz")))
        assert now(index) == [(True, 2, 2)]
        assert now(index.insert(docs((7, "a"), (8, "b")))) == [(True, 7, 3), (True, 8, 1)]


def test_index_decides_what_is_new(spark, monkeypatch):
    """Partial counts of a text reach its bucket one after another; without the index's verdict each would be a text of its own."""
    docs = spark.createDataFrame([(i, "same text") for i in range(200)], "doc_id long, text string")
    got = E.exact_dedup(docs).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(199, 200)}
    hits = []
    held, find = E.Bucket(), E.Bucket.find
    monkeypatch.setattr(E.Bucket, "find", lambda self, key: hits.append(find(self, key)) or hits[-1])
    for i in range(5):
        held.add(b"k" * 32, i, 2)
    assert [h is not None for h in hits] == [False, True, True, True, True] and held.keys[b"k" * 32] == [4, 10]


def near_rows() -> list[tuple]:
    """Chains and clouds of edited copies round the threshold, beside the edge cases."""
    r = random.Random(11)
    rows = brute.edge_rows()
    at = 100
    for size in (30, 120, 700):
        base = [f"b{size}x{r.randrange(10**6)}" for _ in range(size)]
        for k in range(14):
            words = list(base)
            for _ in range(r.randrange(0, max(2, size // 16))):
                words[r.randrange(size)] = f"e{r.randrange(10**6)}"
            rows.append((at, " ".join(words), "en", "s", 1, None, 1, ""))
            at += 1
    return rows


def test_near_components_equal_brute_force(spark):
    rows = near_rows()
    for words in (4, 5):
        want = brute.near(rows, words)
        got = N.near_dedup(spark.createDataFrame(rows, brute.DOCS), words=words).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        sizes = collections.Counter((r[0], len(brute.shingles(r[1], words))) for r in rows)
        assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes
        kept = collections.Counter(r.doc_id for r in got if r.kept)
        # one row of each component, each row without words, each row without an id
        assert kept[8] == 1 and kept[0] == 2 and kept[None] == 2 and kept[9] == 0


def test_near_stage_keeps_columns_and_one_of_each_group(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    got = N.drop_near_copies(docs)
    assert got.columns == docs.columns
    want = brute.near(rows, 5)
    held = [r.doc_id for r in got.collect()]
    assert set(held) == {i for i, c in want.items() if i == c} | {None}
    assert collections.Counter(held) == collections.Counter(r.doc_id for r in N.near_dedup(docs).where("kept").collect())  # stage and query keep the same rows
    assert N.drop_near_copies(docs.limit(0)).count() == 0


def test_ids_with_several_sets_lose_no_link(spark):
    """An id repeated with two texts of equal set size stands for both of them, and each of them brings in its near copies."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    text = lambda words, k=None: " ".join(w if i != k else "edited" for i, w in enumerate(words))
    rows = [(1, text(a), "g"), (1, text(b), "g"), (1, text(a), "g"), (2, text(a, 59), "g"), (3, text(b, 59), "g"), (4, "other words " * 9, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert sorted((r.doc_id, r.text[:2]) for r in N.drop_near_copies(docs).collect()) == [(1, "a0"), (1, "b0"), (4, "ot")]


def test_links_at_the_very_threshold_count(spark):
    """Sets of 9 and 9 with 8 in common: 80 of 100."""
    a = " ".join(f"t{i}" for i in range(12))  # nine shingles of four
    b = " ".join(f"t{i}" for i in range(11)) + " other"
    got = {r.doc_id: r.component_id for r in N.near_dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), words=4).collect()}
    assert got == {1: 1, 2: 1}


def test_similar_texts_share_a_table_nearly_always():
    r = np.random.Generator(np.random.PCG64(1))
    miss = 0
    for _ in range(300):
        shared, x, y = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (160, 20, 20))
        a, b = (N.half_keys(N.minhashes(np.concatenate([shared, z]))) for z in (x, y))
        same = a == b
        miss += not (same[: N.SIDE].any() and same[N.SIDE :].any())
    assert miss <= 1


def test_pairs_under_the_limit_are_not_sent_to_confirmation(spark, monkeypatch):
    """200 texts of 700 shingles that share three quarters: none is a link, and blocks tell so by themselves."""
    base = [f"b{i}" for i in range(604)]
    rows = [(k, " ".join(base + [f"own{k}x{i}" for i in range(100)])) for k in range(200)]
    sent, confirmed = [], N._confirmed
    monkeypatch.setattr(N, "_confirmed", lambda pairs, *rest: sent.append(pairs.count()) or confirmed(pairs, *rest))
    got = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert sum(sent) < 2000


def test_long_sets_near_the_limit_equal_brute_force(spark):
    """Sets beyond what blocks compare whole: both sides of the limit, each pair once."""
    r = random.Random(21)
    base = [f"b{i}" for i in range(6000)]
    rows = []
    for k, changed in enumerate((0, 60, 100, 120, 140, 150, 160, 200, 300)):
        words = list(base)
        for i in range(changed):
            words[i * (6000 // (changed or 1)) + 3] = f"e{k}x{r.randrange(10**6)}"
        rows.append((k + 1, " ".join(words)))
    got = {x.doc_id: x.component_id for x in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows, 5)
