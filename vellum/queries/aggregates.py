"""Aggregations over lines, regions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellum.functions import text as T
from vellum.plans.report import FIGURES_SQL, METRICS_SQL, group_report, image_report, median_or_zero, mean_or_zero, region_metrics, share
from vellum.queries.geometry import LEANT_ANGLE_SQL, leant_angle
from vellum.queries.registry import query
from vellum.sources.layout import LINES_SQL, text_lines
from vellum.sources.tables import read_table


@query("A1_mean_colours", f"WITH {LINES_SQL} SELECT page_id, CAST(round_even(avg(fg_r), 0) AS BIGINT) AS r, CAST(round_even(avg(fg_g), 0) AS BIGINT) AS g, CAST(round_even(avg(fg_b), 0) AS BIGINT) AS b FROM lines GROUP BY page_id")
def mean_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    half_even = lambda c: F.bround(F.avg(c)).cast("long")
    return text_lines(spark, sf_dir).groupBy("page_id").agg(half_even("fg_r").alias("r"), half_even("fg_g").alias("g"), half_even("fg_b").alias("b"))


MAJORITY_SQL = f"""WITH {LINES_SQL}, s AS (SELECT page_id, line_id, CASE WHEN h > w THEN 'v' ELSE 'h' END AS direction, CAST(greatest(w, h) AS DOUBLE) / least(w, h) AS shape FROM lines),
n AS (SELECT page_id, count(*) FILTER (direction = 'h') AS nh, count(*) FILTER (direction = 'v') AS nv FROM s GROUP BY page_id),
r AS (SELECT page_id, direction, row_number() OVER (PARTITION BY page_id ORDER BY shape DESC, line_id) AS nth FROM s)
SELECT n.page_id, CASE WHEN nh > nv THEN 'h' WHEN nv > nh THEN 'v' ELSE r.direction END AS direction FROM n JOIN r ON r.page_id = n.page_id AND r.nth = 1"""


@query("A2_majority_direction", MAJORITY_SQL)
def majority_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties go to the line of the most drawn-out shape, the first of equals."""
    way = F.when(F.col("h") > F.col("w"), "v").otherwise("h")
    lines = text_lines(spark, sf_dir).select("page_id", "line_id", way.alias("way"), (F.greatest("w", "h") / F.least("w", "h")).alias("shape"))
    sums = lines.groupBy("page_id").agg(F.count_if(F.col("way") == "h").alias("nh"), F.count_if(F.col("way") == "v").alias("nv"), F.min_by("way", F.struct(-F.col("shape"), "line_id")).alias("drawn"))
    return sums.select("page_id", F.when(F.col("nh") > F.col("nv"), "h").when(F.col("nv") > F.col("nh"), "v").otherwise(F.col("drawn")).alias("direction"))


@query(
    "A3_first_majority",
    f"""WITH {LINES_SQL}, s AS (SELECT page_id, CASE WHEN h > w THEN 'v' ELSE 'h' END AS direction, count(*) AS n, min(line_id) AS first FROM lines GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS nth FROM s) SELECT page_id, direction FROM r WHERE nth = 1""",
)
def first_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.when(F.col("h") > F.col("w"), "v").otherwise("h").alias("direction")
    counts = text_lines(spark, sf_dir).groupBy("page_id", way).agg(F.count("*").alias("n"), F.min("line_id").alias("first"))
    return counts.groupBy("page_id").agg(F.min_by("direction", F.struct(-F.col("n"), "first")).alias("direction"))


@query("A21_orientation_vote", f"WITH {LINES_SQL} SELECT page_id, CASE WHEN 2 * count(*) FILTER (h > w) > count(*) THEN 'v' ELSE 'h' END AS orientation FROM lines GROUP BY page_id")
def orientation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing where more than half of a page's lines are."""
    standing = 2 * F.count_if(F.col("h") > F.col("w")) > F.count("*")
    return text_lines(spark, sf_dir).groupBy("page_id").agg(F.when(standing, "v").otherwise("h").alias("orientation"))


@query(
    "A4_region_probability",
    f"WITH {LINES_SQL}, t AS (SELECT page_id, sum(w * h) AS total FROM lines GROUP BY page_id) SELECT l.page_id, h > w AS tall, round(exp(sum(ln(prob) * w * h / total)), 8) AS prob FROM lines l JOIN t ON t.page_id = l.page_id GROUP BY 1, 2",
)
def region_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs weighed by area over the area of the whole page."""
    area = F.col("w") * F.col("h")
    lines = text_lines(spark, sf_dir).withColumn("share", area / F.sum(area).over(Window.partitionBy("page_id")))
    return lines.groupBy("page_id", (F.col("h") > F.col("w")).alias("tall")).agg(F.round(F.exp(F.sum(F.log("prob") * F.col("share"))), 8).alias("prob"))


@query("A5_font_size", f"WITH {LINES_SQL} SELECT page_id, CAST(min(least(w, h)) AS INT) AS font_size FROM lines GROUP BY page_id")
def font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("page_id").agg(F.min(F.least("w", "h")).cast("int").alias("font_size"))


@query(
    "A6_mean_angle",
    f"WITH {LINES_SQL}, a AS (SELECT page_id, degrees(avg({LEANT_ANGLE_SQL})) - 90 AS angle FROM lines GROUP BY page_id) SELECT page_id, round(CASE WHEN abs(angle) < 3 THEN 0 ELSE angle END, 6) + 0.0 AS angle FROM a",
)
def mean_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over lines leant over a little; 0 where it is within 3 degrees of level."""
    angles = text_lines(spark, sf_dir).groupBy("page_id").agg((F.degrees(F.avg(leant_angle())) - 90).alias("angle"))
    return angles.select("page_id", (F.round(F.when(F.abs("angle") < 3, 0.0).otherwise(F.col("angle")), 6) + F.lit(0.0)).alias("angle"))


@query("A7_bounds", f"WITH {LINES_SQL} SELECT page_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, CAST(trunc((min(x) + max(x + w)) / 2.0) AS BIGINT) AS cx FROM lines GROUP BY page_id")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.max(F.col("x") + F.col("w"))
    return text_lines(spark, sf_dir).groupBy("page_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), right.alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), ((F.min("x") + right) / 2).cast("long").alias("cx"))


@query("A8_joined_text", f"WITH {LINES_SQL} SELECT page_id, string_agg(text, ' ' ORDER BY line_id) AS text FROM lines WHERE text <> '' GROUP BY page_id")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "text"))).alias("parts"))
    return lines.select("page_id", T.joined(F.transform("parts", lambda p: p["text"])).alias("text"))


@query("A9_average_or_zero", f"WITH {LINES_SQL} SELECT page_id, round(coalesce(avg(prob) FILTER (prob > 0.8), 0), 8) AS mean FROM lines GROUP BY page_id")
def average_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("page_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("prob") > 0.8, F.col("prob"))), F.lit(0.0)), 8).alias("mean"))


@query(
    "A10_colour_average",
    f"WITH {LINES_SQL} SELECT page_id, CAST(trunc(greatest(0, least(255, coalesce(avg(fg_r) FILTER (prob > 0.6), 0)))) AS INT) AS fg, CAST(trunc(greatest(0, least(255, coalesce(avg(CASE WHEN prob > 0.8 THEN fg_b ELSE fg_r END), 0)))) AS INT) AS bg FROM lines GROUP BY page_id",
)
def colour_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground of flagged characters; background of flagged ones, the foreground standing in for the others."""
    whole = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.coalesce(c, F.lit(0.0)))).cast("int")
    fg, bg = F.avg(F.when(F.col("prob") > 0.6, F.col("fg_r"))), F.avg(F.when(F.col("prob") > 0.8, F.col("fg_b")).otherwise(F.col("fg_r")))
    return text_lines(spark, sf_dir).groupBy("page_id").agg(whole(fg).alias("fg"), whole(bg).alias("bg"))


@query("A12_mean_and_median", f"WITH {LINES_SQL} SELECT page_id, round(coalesce(avg(w), 0), 6) AS mean, round(coalesce(median(w), 0), 6) AS median FROM lines GROUP BY page_id")
def mean_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("page_id").agg(mean_or_zero(F.col("w")).alias("mean"), median_or_zero(F.col("w")).alias("median"))


@query("A13_share", f"WITH {LINES_SQL} SELECT page_id, round(100.0 * count(*) FILTER (w > 30) / count(*), 6) AS pct FROM lines GROUP BY page_id")
def share_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("page_id").agg(share(F.col("w") > 30).alias("pct"))


@query("A14_image_metrics", f"WITH {LINES_SQL}, {METRICS_SQL} SELECT page_id, {FIGURES_SQL} FROM metrics GROUP BY page_id")
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_report(text_lines(spark, sf_dir))


@query(
    "A15_group_report",
    f"""WITH {LINES_SQL}, {METRICS_SQL}, e AS (SELECT o.o_orderkey AS page_id, CASE o.o_orderkey % 3 WHEN 0 THEN 'complex' WHEN 1 THEN 'easy' ELSE 'medium' END AS complexity, m.* EXCLUDE (page_id) FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN metrics m ON m.page_id = o.o_orderkey)
SELECT complexity, count(DISTINCT page_id) AS images, count(line_id) AS regions, round(100.0 * count(*) FILTER (bubble) / count(line_id), 6) AS bubble_pct, round(avg(font), 6) AS font_mean, round(100.0 * count(*) FILTER (font < 16) / count(line_id), 6) AS small_pct,
round(avg(spacing), 6) AS spacing_mean, round(100.0 * count(*) FILTER (greatest(overflow_w, overflow_h) > 0) / count(line_id), 6) AS overflow_pct, round(100.0 * count(*) FILTER (shrink < 0.999) / count(line_id), 6) AS shrunk_pct FROM e GROUP BY complexity""",
)
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_report(text_lines(spark, sf_dir), read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id")))


@query("A17_running_bounds", f"WITH {LINES_SQL} SELECT page_id, line_id, min(x) OVER o AS x0, max(x + w) OVER o AS x1 FROM lines WINDOW o AS (PARTITION BY page_id ORDER BY line_id)")
def running_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("page_id").orderBy("line_id")
    return text_lines(spark, sf_dir).select("page_id", "line_id", F.min("x").over(over).alias("x0"), F.max(F.col("x") + F.col("w")).over(over).alias("x1"))


@query(
    "A18_best_line",
    f"WITH {LINES_SQL}, r AS (SELECT page_id, line_id, prob, row_number() OVER (PARTITION BY page_id ORDER BY prob DESC, line_id) AS nth FROM lines) SELECT page_id, line_id, prob FROM r WHERE nth = 1",
)
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min(F.struct(-F.col("prob"), "line_id", "prob"))
    return text_lines(spark, sf_dir).groupBy("page_id").agg(best.alias("b")).select("page_id", "b.line_id", "b.prob")


@query("A19_token_counts", "SELECT conv_id, sum(length(text)) AS total, arg_max(length(text), turn) AS last FROM conversations GROUP BY conv_id")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("total"), F.max_by(F.length("text"), "turn").alias("last"))


@query("A20_running_colour", f"WITH {LINES_SQL} SELECT page_id, round(sum(CAST(fg_r AS DOUBLE) / n), 6) AS fg FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM lines) GROUP BY page_id")
def running_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("page_id").agg(F.round(F.avg("fg_r"), 6).alias("fg"))


@query("A22_run_summary", "SELECT count(*) AS total, count(*) FILTER (length(html) > 2000) AS successes FROM pages")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").agg(F.count("*").alias("total"), F.count_if(F.length("html") > 2000).alias("successes"))
