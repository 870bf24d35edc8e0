"""Small batches of a model, handed on together."""

from __future__ import annotations

from vellum.plans.pipeline import batched, batched_column
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_results_of_small_batches_go_on_together(spark):
    """1,000 rows in batches of 16 come as one table from each task."""
    df = batched(spark.range(1000).coalesce(1), lambda f: f.assign(n=len(f)), "id long, n long")
    handed = df.mapInPandas(lambda frames: (f.iloc[:1].assign(n=len(f)) for f in frames), "id long, n long").collect()
    assert [r.n for r in handed] == [1000]
    assert sorted(r.n for r in df.collect()) == [8] * 8 + [16] * 992


def test_a_column_goes_through_in_small_batches(spark):
    df = batched_column(spark.range(100).coalesce(1), "id", lambda v: [len(v)] * len(v), "n", "long")
    assert sorted((r.id, r.n) for r in df.collect()) == [(k, 16 if k < 96 else 4) for k in range(100)]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "k long, t string")
    assert sorted(map(tuple, batched_column(df, "t", lambda v: [t and t.upper() for t in v], "u").select("k", "u").collect())) == [(1, None), (2, ""), (3, "A")]


def test_the_pipeline_builds_no_frame_for_a_small_batch(spark):
    plan = QUERIES["E6_layout_pipeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
