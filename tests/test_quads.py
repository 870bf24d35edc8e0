"""Figures of quads in numpy against the column functions; what decides before distances are worked out drops no pair."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G, polygons as P
from vellum.operators import contours as C, quads as Q, regions as R
from vellum.queries import QUERIES
from vellum.queries.tilted import tilted

SF = "/root/testdata/sf0.001"


def some(n: int, seed: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(n):
        x, y, w, h, t = r.uniform(0, 40), r.uniform(0, 40), r.uniform(2, 25), r.uniform(2, 25), r.uniform(0, 3)
        corners = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
        out.append(np.round(corners @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + (x, y)))
    return np.array(out)


def test_figures_equal_those_of_columns(spark):
    p, q = some(150, 1), some(150, 2)
    by = np.linspace(1.0, 9.0, 150)
    rows = [(k, [tuple(v) for v in a.tolist()], [tuple(v) for v in b.tolist()], float(d)) for k, (a, b, d) in enumerate(zip(p, q, by))]
    df = spark.createDataFrame(rows, "k int, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>, d double")
    df = P.settled(df.withColumn("x", F.get("q", F.lit(0))["x"]).withColumn("y", F.get("q", F.lit(0))["y"]))
    wide = P.widened(F.col("p"), F.col("d"), C.ARC)
    got = df.select("k", G.quad_gap(F.col("p"), F.col("q")).alias("gap"), P.shared_area(F.col("p"), F.col("q")).alias("shared"), P.point_gap(F.col("x"), F.col("y"), F.col("p")).alias("far"), F.size(wide).alias("n"), P.area(wide).alias("area")).orderBy("k").collect()
    points, area = Q.widened(p, by, C.ARC)
    for r, *want in zip(got, Q.gaps(p, q), Q.shared_areas(p, q), Q.point_gaps(q[:, 0], p), points, area):
        assert [r.gap, r.shared, r.far, r.n, r.area] == pytest.approx(want, abs=1e-7)
    assert sum(r.shared > 0 for r in got) > 20 and sum(r.gap > 0 for r in got) > 20


def test_bounds_decide_before_distances_and_drop_no_pair(spark):
    quads = tilted(spark, SF).where("page_id < 600")
    a, b = (quads.select("page_id", *[F.col(c).alias(f"{s}_{c}") for c in quads.columns if c != "page_id"]) for s in "ab")
    every = P.settled(a.join(b, "page_id").where("a_line_id < b_line_id")).withColumn("gap", G.quad_gap(F.col("a_p"), F.col("b_p")))
    want = {(r.page_id, r.a_line_id, r.b_line_id) for r in every.where(G.can_merge_quads("a", "b", **R.MERGE)).collect()}
    got = {(r.page_id, r.a_line_id, r.b_line_id) for r in R.tilted_pairs(quads).collect()}
    assert got == want and got


@pytest.mark.parametrize("name", ["G7_quad_gap", "G9_tilted_area"])
def test_next_lines_need_no_join_of_all_pairs(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of items and parts
