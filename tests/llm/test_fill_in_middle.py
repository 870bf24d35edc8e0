"""Fill-in-middle against a plain version, and exact round trips."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vellum.llm import fill_in_middle as M

MARKED = ["has <P> inside", "a<S>", "<M>", "<P", "<<P>", "ends with <", "S>M>", "😀é中" * 50, "퟿￿ odd \x00 signs", "a\r\nb\n\nc"]


def plain(doc_id: int | None, text: str | None) -> tuple:
    """One code point at a time."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def rows(spark):
    every = brute.edge_rows()
    every += [(1000 + i, t, None, None, None, "r", i, "d") for i, t in enumerate(MARKED * 20)]
    return every, spark.createDataFrame(every, brute.DOCS)


def test_outputs_equal_plain_version(spark):
    every, docs = rows(spark)
    got = sorted(map(repr, (tuple(r) for r in M.fill_in_middle(docs).drop("output_sha256").collect())))
    assert got == sorted(repr(plain(r[0], r[1])) for r in every)
    assert {plain(r[0], r[1])[2] for r in every} == {"plain", "psm", "spm"}


def test_round_trip_digests(spark):
    every, docs = rows(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(repr((*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t or ""))) for i, t, *_ in every)
    assert sorted(repr(tuple(r)) for r in M.round_trip(docs).collect()) == want
    assert M.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [M.WORDS, M.LINES])
def test_other_units_cut_at_their_ends(spark, unit):
    every, docs = rows(spark)
    out = M.fill_in_middle(docs, unit=unit, rate=100)
    back = out.withColumn("back", M.restored(F.col("form"), F.col("output"))).collect()
    texts = {r[0]: r[1] or "" for r in every if r[0] is not None}
    pattern = M.matcher(unit)
    for r in back:
        if r.doc_id is not None:
            text = texts[r.doc_id]
            assert r.back == text
            ends = {0, *(m.end() for m in pattern.finditer(text))}
            assert r.n == len(ends) - 1
            if r.form != "plain":
                assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_shares_of_the_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = {r.form: r["count"] for r in M.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 720) < 110
