"""A corpus pipeline of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and reread as the next one's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.exact_dedup import drop_exact_copies
from vellum.llm.mixing import mixed
from vellum.llm.near_dedup import drop_near_copies
from vellum.llm.pieces import segment
from vellum.llm.quality_rules import keep_quality
from vellum.sources.scratch import Scratch
from vellum.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row; a row that mixing repeats has its samples repeated."""
    return segment(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("sampled pieces", pieces)]

#: Minimum hashes and sampled segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``; each stage's rows are written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        out = scratch.write(stage(spark, docs, sf_dir), f"stage-{at}", keep=True)
        if at:
            scratch.drop(docs._vellum_path)
        docs = out
    return docs
