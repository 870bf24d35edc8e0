"""Texts laid out many at once against the plain way, one at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T, wrapping as W
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = ["a", "ring", "large", "-x", "x-", "a-b", "extraordinarily", "incomprehensibilities", "好", "日本語テキスト", "\U0001f600", "nul\0l", "...", "!"]
BLANKS = [" ", " ", " ", "  ", "\n", "\t ", " ", "　"]


def texts(n: int, seed: int) -> list[str]:
    r = np.random.Generator(np.random.PCG64(seed))
    out = ["", " ", "   ", "large ring", "... ! ... !", "ring " * 80, "好" * 700, "x" * 600]
    for _ in range(n):
        some = [WORDS[k] + BLANKS[b] for k, b in zip(r.integers(0, len(WORDS), r.integers(0, 12)), r.integers(0, len(BLANKS), 12))]
        out.append(("", " ", "")[r.integers(3)] + ("".join(some).rstrip(" ") if r.random() < 0.7 else "".join(some)))
    return out


def test_many_at_once_equal_one_at_a_time(spark):
    r = np.random.Generator(np.random.PCG64(7))
    rows = [(k, t, int(r.integers(1, 40)), float(r.integers(1, 200)), float(r.integers(1, 200)), ("en_US", "ja")[int(r.integers(2))], bool(r.integers(2))) for k, t in enumerate(texts(4000, 3))]
    rows += [(len(rows), None, 10, 20.0, 20.0, "en_US", True), (len(rows) + 1, "ring", None, 20.0, 20.0, "en_US", False)]
    df = spark.createDataFrame(rows, "k long, t string, size int, w double, h double, lang string, wide boolean")
    columns = T.wrapped_columns(F.col("t"), F.col("h"), F.col("size"), F.floor(F.col("size") * 0.6))
    df = df.withColumn("c", F.struct(F.size(columns).alias("n"), F.array_max(F.transform(columns, lambda c: c["height"])).alias("most")))
    seen = 0
    for x in df.withColumn("laid", W.laid_in_box("t", "size", "w", "h", "lang", "wide")).collect():
        if x.t is None or x.size is None:
            assert x.laid is None
            continue
        if x.wide:
            lines = W.wrap(x.t, x.size, x.w, x.h, x.lang)
            want = (len(lines), max((n for _, n in lines), default=0))
            seen += want[0] > 1
        else:
            want = (x.c.n, x.c.most)
        assert tuple(x.laid) == want, x
    assert seen > 500


def test_most_texts_of_the_pages_are_laid_out_together():
    some = ["large ring large ring", "hot bolt hot bolt", "... ! ... !", "     "] * 50
    code = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
    long = np.array([len(t) for t in some])
    settled, lines, extent = W.laid_rows(code, np.cumsum(long) - long, long, np.full(200, 17), np.full(200, 40.0), np.full(200, 17.0))
    assert settled.all()
    assert [*zip(lines.tolist(), extent.tolist())] == [(len(x), max((n for _, n in x), default=0)) for x in (W.wrap(t, 17, 40.0, 17.0) for t in some)]


@pytest.mark.parametrize("name", ["G22_overflow_scales", "G23_resized_regions", "G36_laid_out"])
def test_lines_and_columns_come_from_one_pass(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
