"""Text lines and regions derived from the driver's tables.

The driver's tables hold no page images, so lines come from ``lineitem`` and
``part`` by fixed arithmetic: a page is an order, a line an item of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellum.sources.tables import read_table

#: The same lines in SQL, for WITH.
LINES_SQL = """lines AS (
  SELECT l.l_orderkey AS page_id,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity, l.l_shipdate, l.l_discount, l.l_tax) AS line_id,
         (l.l_partkey % 40) * 5 AS x, (l.l_suppkey % 40) * 5 AS y,
         CASE WHEN l.l_suppkey % 3 = 0 THEN 10 + CAST(floor(l.l_quantity) AS BIGINT) % 15 ELSE 20 + CAST(floor(l.l_quantity) AS BIGINT) % 30 END AS w,
         CASE WHEN l.l_suppkey % 3 = 0 THEN 20 + CAST(floor(l.l_quantity) AS BIGINT) % 30 ELSE 10 + CAST(floor(l.l_quantity) AS BIGINT) % 15 END AS h,
         round(0.5 + 4 * l.l_discount, 4) AS prob,
         CASE WHEN l.l_linenumber = 7 THEN '  ' WHEN l.l_suppkey % 10 = 0 THEN '... !' ELSE p.p_name END AS text,
         (l.l_partkey * 7) % 256 AS fg_r, (l.l_partkey * 11) % 256 AS fg_g, (l.l_suppkey * 13) % 256 AS fg_b
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, line_id, x, y, w, h, prob, text, fg_r, fg_g, fg_b; axis-aligned, with w unlike h."""
    items = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    q = F.floor("l_quantity").cast("long")
    tall = F.col("l_suppkey") % 3 == 0
    wide, narrow = 20 + q % 30, 10 + q % 15
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("page_id"),
        F.row_number().over(order).cast("long").alias("line_id"),
        (F.col("l_partkey") % 40 * 5).alias("x"),
        (F.col("l_suppkey") % 40 * 5).alias("y"),
        F.when(tall, narrow).otherwise(wide).alias("w"),
        F.when(tall, wide).otherwise(narrow).alias("h"),
        F.round(0.5 + 4 * F.col("l_discount"), 4).alias("prob"),
        F.when(F.col("l_linenumber") == 7, "  ").when(F.col("l_suppkey") % 10 == 0, "... !").otherwise(F.col("p_name")).alias("text"),
        (F.col("l_partkey") * 7 % 256).alias("fg_r"),
        (F.col("l_partkey") * 11 % 256).alias("fg_g"),
        (F.col("l_suppkey") * 13 % 256).alias("fg_b"),
    )
