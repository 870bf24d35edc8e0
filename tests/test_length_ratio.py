"""Places of texts are counted once a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_each_text_is_looked_through_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    plan = QUERIES["G23_resized_regions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 0 < plan.count("regexp") <= 4


def test_ratio_of_places(spark):
    df = spark.createDataFrame([("", "ab"), ("  ", None), (" ab ", " abcd"), ("ab", None), (2 * T.HALF_WIDTH[0], "ab")], "a string, b string")
    places = [T.places_of(T.strip(F.coalesce(c, F.lit("")))) for c in ("a", "b")]
    rows = df.select(T.length_ratio(F.col("a"), F.col("b")).alias("one"), T.ratio_of(*places).alias("two")).collect()
    assert [r.one for r in rows] == [r.two for r in rows] == [1.0, 1.0, 2.0, 0.5, 2.0]
