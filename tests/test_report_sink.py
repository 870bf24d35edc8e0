"""Reports written whole or not at all, and a pipeline that is observed as it runs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from vellum.plans.pipeline import Pipeline, Step, batched
from vellum.plans.report import group_report
from vellum.queries.layout import LAYOUT_STEPS
from vellum.queries.windows import pages_of
from vellum.sources.layout import text_lines
from vellum.sources.report_sink import write_report

SF = "/root/testdata/sf0.001"


def test_json_and_markdown_of_the_group_report(spark, tmp_path):
    report = group_report(text_lines(spark, SF), pages_of(spark, SF)).orderBy("complexity")
    rows = report.collect()
    for _ in range(2):  # again, in place of the first
        write_report(report, f"file://{tmp_path}/json")
    got = [json.loads(line) for f in sorted(os.listdir(f"{tmp_path}/json")) if f.startswith("part-") for line in open(f"{tmp_path}/json/{f}")]
    assert got == [r.asDict() for r in rows]
    write_report(report, f"file://{tmp_path}/md", layout="markdown", title="Groups")
    lines = open(f"{tmp_path}/md/report.md").read().splitlines()
    assert lines[:3] == ["# Groups", "", "| " + " | ".join(report.columns) + " |"]
    assert lines[3] == "|---|" + "---:|" * (len(report.columns) - 1)
    assert [x.split(" | ")[0] for x in lines[4:]] == [f"| {r.complexity}" for r in rows]
    assert lines[4].endswith(f"{rows[0].shrunk_pct:.1f} |")
    assert json.load(open(f"{tmp_path}/json/_SUCCESS"))["rows"] == len(rows)
    assert not [f for f in os.listdir(f"{tmp_path}/md") if f.startswith("_work")]


def test_an_attempt_that_failed_leaves_no_row(spark, tmp_path):
    """An attempt's file that was never reported is not put in place: a second attempt's rows count once."""
    from vellum.sources.report_sink import ReportWriter

    class Attempt:
        def __init__(self, partition: int, attempt: int) -> None:
            self.partition, self.attempt = partition, attempt

        def partitionId(self) -> int:  # noqa: N802
            return self.partition

        def taskAttemptId(self) -> int:  # noqa: N802
            return self.attempt

    df = spark.createDataFrame([(k, f"t|{k}") for k in range(6)], "k int, t string")
    rows, writer = df.collect(), ReportWriter({"path": f"file://{tmp_path}/r"}, df.schema, True)
    held = TaskContext.get

    def broken() -> object:
        yield from rows[:2]
        raise OSError("executor lost")

    try:
        TaskContext.get = staticmethod(lambda: Attempt(0, 1))
        with pytest.raises(OSError):
            writer.write(broken())
        TaskContext.get = staticmethod(lambda: Attempt(0, 2))
        message = writer.write(iter(rows))
    finally:
        TaskContext.get = held
    writer.commit([None, message])
    assert [json.loads(x)["k"] for x in open(f"{tmp_path}/r/part-00000.json")] == list(range(6))
    again = ReportWriter({"path": f"file://{tmp_path}/r"}, df.schema, True)
    again.abort([])
    assert sorted(os.listdir(f"{tmp_path}/r")) == ["_SUCCESS", "part-00000.json"]


def test_a_job_that_fails_leaves_what_was_there(spark, tmp_path):
    write_report(spark.range(3), f"file://{tmp_path}/r")
    bad = spark.range(8).select(F.when(F.col("id") == 6, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        write_report(bad, f"file://{tmp_path}/r")
    assert sorted(int(json.loads(x)["id"]) for f in os.listdir(f"{tmp_path}/r") if f.startswith("part") for x in open(f"{tmp_path}/r/{f}")) == [0, 1, 2]
    assert not [f for f in os.listdir(f"{tmp_path}/r") if f.startswith("_work")]


def test_one_run_gives_the_report_and_its_figures(spark, tmp_path):
    lines, jobs = text_lines(spark, SF), []
    figures = Pipeline(LAYOUT_STEPS).run(lines, lambda df: jobs.append(df.write.parquet(f"{tmp_path}/out")))
    kept = lines.where(F.trim("text") != "")
    assert figures["text"]["rows"] == kept.count()
    sure = kept.where("prob >= 0.55")
    assert figures["sure"]["rows"] == figures["translated"]["rows"] == sure.count()
    assert figures["sure"]["mean_prob"] == pytest.approx(sure.agg(F.avg("prob")).first()[0])
    assert figures["report"]["rows"] == spark.read.parquet(f"{tmp_path}/out").count() and len(jobs) == 1
    with pytest.raises(ValueError, match="names"):
        Pipeline([LAYOUT_STEPS[0], LAYOUT_STEPS[0]])


def test_the_batch_function_is_the_callers(spark):
    sizes = batched(spark.range(100).coalesce(1), lambda f: f.assign(n=len(f))[["n"]].iloc[:1], "n long", size=16).collect()
    assert sorted(r.n for r in sizes) == [4] + [16] * 6
    assert Step("x", lambda df: df).figures == ()
