"""Small images as pixel rows: border strips, colour, masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.operators import masks as M
from vellum.queries.registry import query
from vellum.sources.layout import LINES_SQL, text_lines
from vellum.sources.tables import read_table

#: An image for each part: a third of them grey, with colours from fixed arithmetic.
PIXELS_SQL = """images AS (SELECT p_partkey AS image_id, 12 + p_size % 9 AS w, 10 + p_partkey % 7 AS h FROM part),
cells AS (SELECT image_id, w, h, px, unnest(range(0, h)) AS py FROM (SELECT *, unnest(range(0, w)) AS px FROM images)),
raw AS (SELECT *, (px * 37 + py * 11 + image_id * 7) % 256 AS r, (px * 5 + image_id * 3) % 256 AS g0, (py * 13 + image_id) % 256 AS b0 FROM cells),
pixels AS (SELECT image_id, w, h, px, py, r, CASE WHEN image_id % 3 = 0 THEN r ELSE g0 END AS g, CASE WHEN image_id % 3 = 0 THEN r ELSE b0 END AS b FROM raw)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, px, py, r, g, b."""
    k = F.col("p_partkey")
    images = read_table(spark, sf_dir, "part").select(k.alias("image_id"), (12 + F.col("p_size") % 9).alias("w"), (10 + k % 7).alias("h"))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    cells = images.withColumn("px", span("w")).withColumn("py", span("h"))
    i, px, py = F.col("image_id"), F.col("px"), F.col("py")
    red, grey = (px * 37 + py * 11 + i * 7) % 256, i % 3 == 0
    return cells.select("image_id", "w", "h", "px", "py", red.alias("r"), F.when(grey, red).otherwise((px * 5 + i * 3) % 256).alias("g"), F.when(grey, red).otherwise((py * 13 + i) % 256).alias("b"))


#: Weights of red, green and blue in grey, and the same in 16,384ths; the last black grey.
GREY, GREY_WHOLE, BLACK = (0.299, 0.587, 0.114), (4899, 9617, 1868), 127
BLACK_SQL = "(r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 <= 127"
COLOUR_SQL = "(pow(r - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 2) + pow(g - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 2) + pow(b - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 2)) > 100"
STRIPS_SQL = "CASE WHEN py < 2 THEN 'top' WHEN py >= h - 2 THEN 'bottom' WHEN px < 2 THEN 'left' WHEN px >= w - 2 THEN 'right' END"


def is_black() -> Column:
    """Whether a pixel's grey, rounded to 8 bits, is at most BLACK."""
    return F.floor((F.col("r") * GREY_WHOLE[0] + F.col("g") * GREY_WHOLE[1] + F.col("b") * GREY_WHOLE[2] + 8192) / 16384) <= BLACK


def is_coloured() -> Column:
    """Whether a pixel is further than 10 from its own grey."""
    grey = GREY[0] * F.col("r") + GREY[1] * F.col("g") + GREY[2] * F.col("b")
    return sum(((F.col(c) - grey) * (F.col(c) - grey) for c in "rgb"), F.lit(0.0)) > 100


def strip() -> Column:
    """The border strip of two pixels that a pixel is in: whole rows at the top and bottom, what is left of the columns at the sides."""
    px, py, w, h = (F.col(c) for c in ("px", "py", "w", "h"))
    return F.when(py < 2, "top").when(py >= h - 2, "bottom").when(px < 2, "left").when(px >= w - 2, "right")


@query("P13_colour_check", f"WITH {PIXELS_SQL} SELECT image_id, count(*) FILTER ({COLOUR_SQL}) > 10 AS coloured FROM pixels GROUP BY image_id")
def colour_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("image_id").agg((F.count_if(is_coloured()) > 10).alias("coloured"))


@query("A23_border_counts", f"WITH {PIXELS_SQL}, s AS (SELECT image_id, {STRIPS_SQL} AS strip, {BLACK_SQL} AS black FROM pixels) SELECT image_id, strip, count(*) FILTER (black) AS black, count(*) AS total FROM s WHERE strip IS NOT NULL GROUP BY image_id, strip")
def border_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pixels(spark, sf_dir).select("image_id", strip().alias("strip"), is_black().alias("black")).where("strip IS NOT NULL")
    return held.groupBy("image_id", "strip").agg(F.count_if("black").alias("black"), F.count("*").alias("total"))


def ignored(images: DataFrame, share: int) -> DataFrame:
    """(image_id, ignored): of a share from 1 to 50, images whose borders are neither mostly light nor mostly dark, and coloured ones; other shares ignore none."""
    border = strip().isNotNull()
    sums = images.groupBy("image_id").agg(F.count_if(border & is_black()).alias("black"), F.count_if(border).alias("total"), (F.count_if(is_coloured()) > 10).alias("coloured"))
    ratio = F.round(F.col("black") / F.col("total"), 6) * 100
    found = (F.col("total") > 0) & (ratio.between(share, 100 - share) | F.col("coloured"))
    return sums.select("image_id", (found if 1 <= share <= 50 else F.lit(False)).alias("ignored"))


@query(
    "P12_ignored",
    f"""WITH {PIXELS_SQL}, s AS (SELECT image_id, {STRIPS_SQL} IS NOT NULL AS border, {BLACK_SQL} AS black, {COLOUR_SQL} AS coloured FROM pixels),
n AS (SELECT image_id, count(*) FILTER (border AND black) AS black, count(*) FILTER (border) AS total, count(*) FILTER (coloured) > 10 AS coloured FROM s GROUP BY image_id)
SELECT image_id, total > 0 AND (round(CAST(black AS DOUBLE) / total, 6) * 100 BETWEEN 10 AND 90 OR coloured) AS ignored FROM n""",
)
def p12_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignored(pixels(spark, sf_dir), 10)


@query(
    "A16_mask_union",
    f"""WITH {LINES_SQL}, across AS (SELECT page_id, line_id, y, h, unnest(range(x // 5, (x + w - 1) // 5 + 1)) AS px FROM lines), masks AS (SELECT page_id, line_id, px, unnest(range(y // 5, (y + h - 1) // 5 + 1)) AS py FROM across),
united AS (SELECT page_id, px, py, bit_or(1 << CAST((line_id - 1) % 16 AS INT)) AS mask FROM masks GROUP BY page_id, px, py)
SELECT page_id, count(*) AS area, CAST(sum(mask) AS BIGINT) AS total, CAST(max(mask) AS INT) AS most FROM united GROUP BY page_id""",
)
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's mask has a bit of its own, in cells of 5 pixels; by page the area of the union and what its bits add up to."""

    def figures(pages: np.ndarray, starts: np.ndarray, px: np.ndarray, py: np.ndarray, bits: np.ndarray) -> list:
        return [pages, np.diff(starts, append=len(px)), np.add.reduceat(bits, starts), np.maximum.reduceat(bits, starts)]

    return M.over_pages(text_lines(spark, sf_dir), "page_id bigint, area bigint, total bigint, most int", figures)


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, grey: blots of a light and a dark shade, row by row, as arrays."""
    k = F.col("p_partkey")
    images = read_table(spark, sf_dir, "part").select(k.alias("image_id"), (12 + F.col("p_size") % 9).cast("int").alias("w"), (10 + k % 7).cast("int").alias("h"))

    def shade(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i = c["image_id"]
        light = ((x * (i % 5 + 1) + y * (i % 3 + 2)) % 11 < 7) | ((x + y + i) % 6 == 0)
        return np.where(light, 200 + (x + y) % 20, 40 + x % 10)

    return M.drawn(images, shade)


@query("K2_flood_area")
def flood_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and bounds of the flood from each image's middle."""

    def each(_: int, grey: np.ndarray) -> list[tuple]:
        h, w = grey.shape
        y, x = np.nonzero(M.flood_fill(grey, w // 2, h // 2))
        return [(len(x), int(x.min()), int(y.min()), int(x.max()), int(y.max()))]

    return M.over_images(grey_images(spark, sf_dir), "image_id bigint, area int, x0 int, y0 int, x1 int, y1 int", each)


@query("K3_eroded_area")
def eroded_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that is left of each flood when it is eroded by up to 5 pixels."""

    def each(_: int, grey: np.ndarray) -> list[tuple]:
        h, w = grey.shape
        left = M.eroded(M.flood_fill(grey, w // 2, h // 2), w // 2, h // 2, 5)
        return [(int(left.sum()),)]

    return M.over_images(grey_images(spark, sf_dir), "image_id bigint, area int", each)


@query("K6_labelled_components")
def labelled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, area and bounds of each component of light pixels."""

    def each(_: int, grey: np.ndarray) -> list[tuple]:
        return [(n, area, x, y, w, h) for n, (area, x, y, w, h) in enumerate(M.extents(M.labelled(grey > 127)), 1)]

    return M.over_images(grey_images(spark, sf_dir), "image_id bigint, label int, area int, x int, y int, w int, h int", each)
