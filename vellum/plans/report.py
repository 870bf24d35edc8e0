"""The diagnostics report: figures of regions, by image and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.geometry import inner_margin

#: Decimals of the report's figures.
DIGITS = 6


def mean_or_zero(c: Column) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS)


def median_or_zero(c: Column) -> Column:
    return F.round(F.coalesce(F.median(c), F.lit(0.0)), DIGITS)


def share(test: Column) -> Column:
    """Percentage of rows that pass, 0 for none."""
    return F.round(F.coalesce(100.0 * F.count_if(test) / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)), DIGITS)


def overflow_figures(w: Column, h: Column, chars: Column, font: Column, wide: Column, count: Column, extent: Column) -> dict[str, Column]:
    """spacing, overflow_w, overflow_h, shrink and centering of a text of ``count`` lines (columns where not ``wide``), the widest ``extent`` pixels, in a box.

    The text with its border needs room inside the box's margin; what it lacks is the overflow, what it is scaled by to fit
    the shrink. Centring rounds down, so an odd rest makes the sides a pixel unlike.
    """
    border = F.greatest((font * 0.07).cast("int"), F.lit(1))
    around = (font + border) * 2
    spacing = F.when(wide, F.greatest((font * 0.15).cast("int"), F.lit(3))).otherwise(F.greatest((font * 0.10).cast("int"), F.lit(2)))
    stacked = font * count + spacing * (count - 1)
    need_w, need_h = F.when(wide, extent).otherwise(stacked) + around, F.when(wide, stacked).otherwise(h) + around
    margin = inner_margin(F.least(w, h), chars)
    room_w, room_h = F.greatest(F.lit(1), w - margin * 2), F.greatest(F.lit(1), h - margin * 2)
    over = lambda need, room: F.greatest(F.lit(0.0), (need - room) / room)
    rest = lambda need, room: (room - F.least(need, room)) % 2
    return {
        "spacing": spacing, "overflow_w": over(need_w, room_w), "overflow_h": over(need_h, room_h),
        "shrink": F.least(F.lit(1.0), room_w / need_w, room_h / need_h), "centering": rest(need_w, room_w) + rest(need_h, room_h),
    }


def region_metrics(lines: DataFrame) -> DataFrame:
    """A metric row for each line, as if rendered in its box; lines and columns are counted by the whole text's length."""
    small, size = F.least("w", "h"), F.length("text")
    df = lines.select("page_id", "line_id", "prob", small.cast("int").alias("font_original"), (small + F.col("line_id") % 3).cast("int").alias("font"), size.alias("chars"), "w", "h")
    w, h, font, wide = F.col("w"), F.col("h"), F.col("font"), F.col("w") > F.col("h")
    across, length = F.greatest(w, font * 2), F.col("chars") * F.floor(font * 55 / 100)
    count = F.greatest(F.lit(1), F.when(wide, F.ceil(length / across)).otherwise(F.ceil(F.col("chars") * F.floor(font * 60 / 100) / h)))
    held = overflow_figures(w, h, F.col("chars"), font, wide, F.col("line_count"), F.least(length, across))
    return df.withColumn("line_count", count).select(
        "page_id", "line_id", (F.col("prob") >= 0.7).alias("bubble"), "font", (font - F.col("font_original")).alias("font_delta"), "line_count", *[c.alias(n) for n, c in held.items()],
    )


#: The same rows in SQL, for WITH, after the lines.
METRICS_SQL = """sized AS (SELECT page_id, line_id, prob, least(w, h) AS original, least(w, h) + line_id % 3 AS font, length(text) AS chars, w, h, least(w, h) AS side FROM lines),
counted AS (SELECT *, chars * (font * 55 // 100) AS length, greatest(w, font * 2) AS across, greatest(1, font * 7 // 100) AS border, CASE WHEN w > h THEN greatest(font * 15 // 100, 3) ELSE greatest(font // 10, 2) END AS spacing,
  CASE WHEN side < 70 THEN greatest(1, CAST(round_even(side * 0.02::DOUBLE, 0) AS BIGINT)) WHEN side < 120 THEN greatest(2, CAST(round_even(side * 0.03::DOUBLE, 0) AS BIGINT)) ELSE 2 END AS margin FROM sized),
laid AS (SELECT *, greatest(1, CASE WHEN w > h THEN (length + across - 1) // across ELSE (chars * (font * 60 // 100) + h - 1) // h END) AS line_count FROM counted),
needed AS (SELECT *, (CASE WHEN w > h THEN least(length, across) ELSE font * line_count + spacing * (line_count - 1) END) + (font + border) * 2 AS need_w,
  (CASE WHEN w > h THEN font * line_count + spacing * (line_count - 1) ELSE h END) + (font + border) * 2 AS need_h, greatest(1, w - margin * 2) AS room_w, greatest(1, h - margin * 2) AS room_h FROM laid),
metrics AS (SELECT page_id, line_id, prob >= 0.7 AS bubble, font, font - original AS font_delta, line_count, spacing, greatest(0.0, CAST(need_w - room_w AS DOUBLE) / room_w) AS overflow_w, greatest(0.0, CAST(need_h - room_h AS DOUBLE) / room_h) AS overflow_h,
  least(1.0, CAST(room_w AS DOUBLE) / need_w, CAST(room_h AS DOUBLE) / need_h) AS shrink, (room_w - least(need_w, room_w)) % 2 + (room_h - least(need_h, room_h)) % 2 AS centering FROM needed)"""


def figures() -> list[Column]:
    """The report's fifteen figures of a group of metric rows."""
    over = F.greatest("overflow_w", "overflow_h")
    return [
        F.count("line_id").alias("regions"), share(F.col("bubble")).alias("bubble_pct"), mean_or_zero(F.col("font")).alias("font_mean"), median_or_zero(F.col("font")).alias("font_median"),
        share(F.col("font") < 16).alias("small_pct"), share(F.col("font") > 48).alias("large_pct"), mean_or_zero(F.col("font_delta")).alias("delta_mean"), mean_or_zero(F.col("spacing")).alias("spacing_mean"),
        share(F.col("line_count") > 1).alias("multiline_pct"), share(over > 0).alias("overflow_pct"), mean_or_zero(over).alias("overflow_mean"), share(F.col("shrink") < 0.999).alias("shrunk_pct"),
        mean_or_zero(F.col("shrink")).alias("shrink_mean"), mean_or_zero(F.col("centering")).alias("centering_mean"), share(F.col("centering") > 1).alias("centering_pct"),
    ]


FIGURES_SQL = """count(line_id) AS regions, round(100.0 * count(*) FILTER (bubble) / count(*), 6) AS bubble_pct, round(coalesce(avg(font), 0), 6) AS font_mean, round(coalesce(median(font), 0), 6) AS font_median,
round(100.0 * count(*) FILTER (font < 16) / count(*), 6) AS small_pct, round(100.0 * count(*) FILTER (font > 48) / count(*), 6) AS large_pct, round(avg(font_delta), 6) AS delta_mean, round(avg(spacing), 6) AS spacing_mean,
round(100.0 * count(*) FILTER (line_count > 1) / count(*), 6) AS multiline_pct, round(100.0 * count(*) FILTER (greatest(overflow_w, overflow_h) > 0) / count(*), 6) AS overflow_pct, round(avg(greatest(overflow_w, overflow_h)), 6) AS overflow_mean,
round(100.0 * count(*) FILTER (shrink < 0.999) / count(*), 6) AS shrunk_pct, round(avg(shrink), 6) AS shrink_mean, round(avg(centering), 6) AS centering_mean, round(100.0 * count(*) FILTER (centering > 1) / count(*), 6) AS centering_pct"""


def image_report(lines: DataFrame) -> DataFrame:
    """The figures of each page."""
    return region_metrics(lines).groupBy("page_id").agg(*figures())


def group_report(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages, regions and the figures of each group; pages without regions count as pages."""
    groups = F.element_at(F.array(F.lit("complex"), F.lit("easy"), F.lit("medium")), (F.col("page_id") % 3 + 1).cast("int"))
    every = pages.select("page_id").distinct().join(region_metrics(lines), "page_id", "left").withColumn("complexity", groups)
    seen = F.col("line_id").isNotNull()
    pct = lambda test: F.round(F.coalesce(100.0 * F.count_if(seen & test) / F.nullif(F.count("line_id"), F.lit(0)), F.lit(0.0)), DIGITS)
    return every.groupBy("complexity").agg(
        F.countDistinct("page_id").alias("images"), F.count("line_id").alias("regions"), pct(F.col("bubble")).alias("bubble_pct"), mean_or_zero(F.col("font")).alias("font_mean"),
        pct(F.col("font") < 16).alias("small_pct"), mean_or_zero(F.col("spacing")).alias("spacing_mean"), pct(F.greatest("overflow_w", "overflow_h") > 0).alias("overflow_pct"), pct(F.col("shrink") < 0.999).alias("shrunk_pct"),
    )
