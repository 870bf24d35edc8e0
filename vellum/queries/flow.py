"""Request flow: limits and pacing over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellum.queries.registry import query
from vellum.sources.tables import read_table
from vellum.streaming.limits import over_limit, waits


@query("R1_over_limit", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def r1_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_limit(read_table(spark, sf_dir, "events"), limit=1).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("R2_pacing", "SELECT event_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 60000000, FALSE) AS wait FROM events")
def r2_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waits(read_table(spark, sf_dir, "events"), pace=60.0).select("event_id", "wait")


@query("R3_history", "SELECT conv_id, count(*) AS kept, min(turn) AS first FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) WHERE nth <= 20 GROUP BY conv_id")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty messages of each conversation, kept apart; twenty rows of a conversation, not all, go through the shuffle."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", nth.alias("nth")).where("nth <= 20")
    return last.groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first"))
