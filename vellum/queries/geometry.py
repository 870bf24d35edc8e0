"""Geometry, colour and layout figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vellum.functions import geometry as G
from vellum.functions.languages import ORIENTATION
from vellum.queries.filters import IMAGE_SQL, images
from vellum.plans.report import METRICS_SQL, region_metrics
from vellum.queries.registry import query
from vellum.sources.layout import LINES_SQL, text_lines


def each_line(spark: SparkSession, sf_dir: str, **columns: object) -> DataFrame:
    return text_lines(spark, sf_dir).select("page_id", "line_id", *[c.alias(n) for n, c in columns.items()])  # type: ignore[attr-defined]


#: The corners of a line leant over, in an order that says nothing.
MIXED_SQL = f"""{LINES_SQL}, leant AS (SELECT page_id, line_id, x + (line_id * 3) % 11 - 5 AS tx, x AS bx, y, w, h FROM lines),
mixed AS (SELECT page_id, line_id, [{{'x': tx + w, 'y': y}}, {{'x': bx, 'y': y + h}}, {{'x': tx, 'y': y}}, {{'x': bx + w, 'y': y + h}}] AS p FROM leant)"""


def mixed_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with p, the corners of MIXED_SQL."""
    x, y, w, h, k = G.cols(*"xywh", "line_id")
    top = x + k * 3 % 11 - 5
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    return text_lines(spark, sf_dir).withColumn("p", F.array(point(top + w, y), point(x, y + h), point(top, y), point(x + w, y + h)))


@query(
    "G1_ordered_corners",
    f"""WITH {MIXED_SQL}, pairs AS (SELECT page_id, line_id, p, unnest([[1, 2], [1, 3], [1, 4], [2, 3], [2, 4], [3, 4]]) AS ij FROM mixed),
d AS (SELECT page_id, line_id, p[ij[1]].x - p[ij[2]].x AS dx, p[ij[1]].y - p[ij[2]].y AS dy FROM pairs),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY dx * dx + dy * dy, dx, dy) AS nth FROM d),
s AS (SELECT a.page_id, a.line_id, CASE WHEN a.dx * b.dx + a.dy * b.dy < 0 THEN -1 ELSE 1 END AS t, a.dx AS px, a.dy AS py, b.dx AS qx, b.dy AS qy FROM k a JOIN k b ON a.page_id = b.page_id AND a.line_id = b.line_id AND a.nth = 3 AND b.nth = 4),
f AS (SELECT page_id, line_id, abs(px * t + qx) <= abs(py * t + qy) AS vertical FROM s),
c AS (SELECT page_id, line_id, unnest(p) AS q FROM mixed),
r AS (SELECT c.page_id, c.line_id, f.vertical, q.x AS x, q.y AS y, row_number() OVER (PARTITION BY c.page_id, c.line_id ORDER BY CASE WHEN f.vertical THEN q.y ELSE q.x END, CASE WHEN f.vertical THEN q.x ELSE q.y END) <= 2 AS leads FROM c JOIN f ON f.page_id = c.page_id AND f.line_id = c.line_id),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_id, leads ORDER BY CASE WHEN vertical THEN x ELSE y END) AS nth FROM r),
n AS (SELECT page_id, line_id, vertical, CASE WHEN vertical THEN CASE WHEN leads THEN nth WHEN nth = 2 THEN 3 ELSE 4 END ELSE CASE WHEN leads THEN CASE nth WHEN 1 THEN 1 ELSE 4 END ELSE nth + 1 END END AS corner, x, y FROM o)
SELECT page_id, line_id, vertical, {", ".join(f"max(x) FILTER (corner = {k}) AS x{k}, max(y) FILTER (corner = {k}) AS y{k}" for k in (1, 2, 3, 4))} FROM n GROUP BY page_id, line_id, vertical""",
)
def ordered_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the top left clockwise, with whether the quad stands."""
    lines = mixed_corners(spark, sf_dir)
    vertical, corners = G.ordered_corners(F.col("p"))
    placed = lines.select("page_id", "line_id", vertical.alias("vertical"), corners.alias("q"))
    return placed.select("page_id", "line_id", "vertical", *[F.col("q")[k][c].alias(f"{c}{k + 1}") for k in range(4) for c in "xy"])


@query("G2_midpoints", f"WITH {LINES_SQL} SELECT page_id, line_id, CAST(trunc((x + x + w) / 2.0) AS BIGINT) AS mx, CAST(trunc((y + y + h) / 2.0) AS BIGINT) AS my FROM lines")
def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = G.cols(*"xywh")
    return each_line(spark, sf_dir, mx=G.truncated_mean(x, x + w), my=G.truncated_mean(y, y + h))


@query("G3_shape", f"WITH {LINES_SQL} SELECT page_id, line_id, round(CAST(w AS DOUBLE) / h, 8) AS aspect, least(w, h) AS font_size FROM lines")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_line(spark, sf_dir, aspect=F.round(F.col("w") / F.col("h"), 8), font_size=G.font_size(F.col("w"), F.col("h")))


@query("G4_area", f"WITH {LINES_SQL} SELECT page_id, line_id, CAST(w * h AS DOUBLE) AS area FROM lines")
def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace sum over the four corners."""
    x, y, w, h = G.cols(*"xywh")
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    twice = sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1])), F.lit(0))
    return each_line(spark, sf_dir, area=F.abs(twice) / 2)


@query("G5_centroid", f"WITH {LINES_SQL} SELECT page_id, line_id, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy FROM lines")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = G.cols(*"xywh")
    return each_line(spark, sf_dir, cx=(x + (x + w) + (x + w) + x) / 4, cy=(y + y + (y + h) + (y + h)) / 4)


#: Lines leant over: the top edge is moved sideways by a few pixels, so that they have an angle.
LEAN_SQL = "((line_id * 3) % 11 - 5)"
#: Angle of the vector from the middle of the top edge to that of the bottom edge, both cut to whole pixels, measured from the vertical.
LEANT_ANGLE_SQL = f"atan2(CAST(trunc((x + x + w) / 2.0) - trunc((x + x + w + 2 * {LEAN_SQL}) / 2.0) AS DOUBLE), CAST(h AS DOUBLE))"


def leant_angle() -> Column:
    """From the vertical: sideways part first."""
    x, w, h = G.cols("x", "w", "h")
    lean = F.col("line_id") * 3 % 11 - 5
    vx = G.truncated_mean(x, x + w) - G.truncated_mean(x + lean, x + w + lean)
    return F.atan2(vx.cast("double"), h.cast("double"))


@query("G6_angle", f"WITH {LINES_SQL}, a AS (SELECT page_id, line_id, {LEANT_ANGLE_SQL} AS angle FROM lines) SELECT page_id, line_id, round(angle, 8) + 0.0 AS angle, abs(angle) < 15 * pi() / 180 AS axis_aligned FROM a")
def angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_line(spark, sf_dir, angle=F.round(leant_angle(), 8) + F.lit(0.0), axis_aligned=F.abs(leant_angle()) < 15 * F.pi() / 180)


@query("G7_gap", f"WITH {LINES_SQL} SELECT a.page_id, a.line_id, round(sqrt(CAST(power(greatest(b.x - (a.x + a.w), a.x - (b.x + b.w), 0), 2) + power(greatest(b.y - (a.y + a.h), a.y - (b.y + b.h), 0), 2) AS DOUBLE)), 6) AS gap FROM lines a JOIN lines b ON a.page_id = b.page_id AND b.line_id = a.line_id + 1")
def gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(spark, sf_dir)
    a = lines.select("page_id", "line_id", *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = lines.select("page_id", (F.col("line_id") - 1).alias("line_id"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    return a.join(b, ["page_id", "line_id"]).select("page_id", "line_id", F.round(G.box_gap("a", "b"), 6).alias("gap"))


NEXT_SQL = "FROM lines a JOIN lines b ON a.page_id = b.page_id AND b.line_id = a.line_id + 1"


@query(
    "G8_rect_distance",
    f"""WITH {LINES_SQL}, d AS (SELECT a.page_id, a.line_id, greatest(a.x - (b.x + b.w), b.x - (a.x + a.w)) AS across, greatest(a.y - (b.y + b.h), b.y - (a.y + a.h)) AS down {NEXT_SQL})
SELECT page_id, line_id, round(CASE WHEN across > 0 AND down > 0 THEN sqrt(CAST(across * across + down * down AS DOUBLE)) ELSE CAST(greatest(across, down, 0) AS DOUBLE) END, 6) AS distance FROM d""",
)
def rect_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line and the next one of its page."""
    lines = text_lines(spark, sf_dir)
    corners = lambda k: [F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"), (F.col("x") + F.col("w")).alias(f"{k}x2"), (F.col("y") + F.col("h")).alias(f"{k}y2")]
    a = lines.select("page_id", "line_id", *corners("a"))
    b = lines.select("page_id", (F.col("line_id") - 1).alias("line_id"), *corners("b"))
    far = G.rect_distance(*G.cols("ax", "ay", "ax2", "ay2", "bx", "by", "bx2", "by2"))
    return a.join(b, ["page_id", "line_id"]).select("page_id", "line_id", F.round(far, 6).alias("distance"))


@query("G11_rotated", f"WITH {LINES_SQL} SELECT page_id, line_id, CAST(trunc(round(x * cos(pi() / 6) - y * sin(pi() / 6), 6)) AS BIGINT) AS rx, CAST(trunc(round(x * sin(pi() / 6) + y * cos(pi() / 6), 6)) AS BIGINT) AS ry FROM lines")
def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By 30 degrees about the page's corner, cut to whole pixels."""
    c, s = F.cos(F.pi() / 6), F.sin(F.pi() / 6)
    whole = lambda v: F.round(v, 6).cast("long")
    return each_line(spark, sf_dir, rx=whole(F.col("x") * c - F.col("y") * s), ry=whole(F.col("x") * s + F.col("y") * c))


#: A page's angle in degrees, from its number.
TILT_SQL = "((page_id % 7) * 5 - 15)"


@query(
    "G12_min_rect",
    f"""WITH {LINES_SQL}, c AS (SELECT page_id, x, y, w, h, (min(x) OVER p + max(x + w) OVER p) / 2.0::DOUBLE AS cx, (min(y) OVER p + max(y + h) OVER p) / 2.0::DOUBLE AS cy, radians({TILT_SQL}) AS t FROM lines WINDOW p AS (PARTITION BY page_id)),
q AS (SELECT page_id, cx, cy, t, unnest([x, x + w, x + w, x]) AS px, unnest([y, y, y + h, y + h]) AS py FROM c),
r AS (SELECT page_id, cx, cy, t, trunc(round((py - cy) * sin(t) + (px - cx) * cos(t) + cx, 6)) AS rx, trunc(round((py - cy) * cos(t) - (px - cx) * sin(t) + cy, 6)) AS ry FROM q),
b AS (SELECT page_id, min(cx) AS cx, min(cy) AS cy, min(t) AS t, min(rx) AS x0, min(ry) AS y0, max(rx) AS x1, max(ry) AS y1 FROM r GROUP BY page_id),
k AS (SELECT page_id, cx, cy, t, unnest([1, 2, 3, 4]) AS n, unnest([x0, x1, x1, x0]) AS px, unnest([y0, y0, y1, y1]) AS py FROM b),
m AS (SELECT page_id, n, trunc(greatest(0, round((cy - py) * sin(t) + (px - cx) * cos(t) + cx, 6))) AS mx, trunc(greatest(0, round((py - cy) * cos(t) + (px - cx) * sin(t) + cy, 6))) AS my FROM k),
p AS (SELECT page_id, list(mx ORDER BY n) AS x, list(my ORDER BY n) AS y FROM m GROUP BY page_id),
z AS (SELECT *, sqrt(pow((x[2] + x[3] - x[4] - x[1]) / 2, 2) + pow((y[2] + y[3] - y[4] - y[1]) / 2, 2)) AS across, sqrt(pow((x[3] + x[4] - x[1] - x[2]) / 2, 2) + pow((y[3] + y[4] - y[1] - y[2]) / 2, 2)) AS down,
  abs(x[1] * y[2] - x[2] * y[1] + x[2] * y[3] - x[3] * y[2] + x[3] * y[4] - x[4] * y[3] + x[4] * y[1] - x[1] * y[4]) / 2 AS area FROM p)
SELECT page_id, {", ".join(f"CAST(x[{n}] AS BIGINT) AS x{n}, CAST(y[{n}] AS BIGINT) AS y{n}" for n in (1, 2, 3, 4))}, round(across, 6) AS across, round(down, 6) AS down, round(across / down, 6) AS aspect, area FROM z WHERE down > 0""",
)
def min_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of a region turned level, turned back: corners, size along both axes, aspect and area; coordinates are cut to whole pixels and not under 0."""
    page = Window.partitionBy("page_id")
    x, y, w, h = G.cols(*"xywh")
    middle = lambda c, size: (F.min(c).over(page) + F.max(c + size).over(page)) / 2
    df = text_lines(spark, sf_dir).withColumns({"cx": middle(x, w), "cy": middle(y, h), "t": F.radians(F.col("page_id") % 7 * 5 - 15)})
    turn = lambda px, py, t: G.turned(px, py, F.col("cx"), F.col("cy"), t)
    corners = [turn(px, py, F.col("t")) for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    ends = [f(*[F.round(c[k], 6).cast("long") for c in corners]).alias(n) for f, k, n in ((F.least, 0, "x0"), (F.least, 1, "y0"), (F.greatest, 0, "x1"), (F.greatest, 1, "y1"))]
    pages = df.select("page_id", "cx", "cy", "t", *ends).groupBy("page_id").agg(*[F.min(c).alias(c) for c in ("cx", "cy", "t", "x0", "y0")], F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    back = [turn(F.col(a), F.col(b), -F.col("t")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    whole = {f"{c}{n}": F.greatest(F.lit(0.0), F.round(v, 6)).cast("long") for n, p in enumerate(back, 1) for c, v in zip("xy", p)}
    quad = pages.select("page_id", *[v.alias(k) for k, v in whole.items()])
    p = [(F.col(f"x{n}"), F.col(f"y{n}")) for n in (1, 2, 3, 4)]
    size = lambda a, b, c, d: F.hypot((a[0] + b[0] - c[0] - d[0]) / 2, (a[1] + b[1] - c[1] - d[1]) / 2)
    area = F.abs(sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])), F.lit(0))) / 2
    quad = quad.withColumns({"across": size(p[1], p[2], p[3], p[0]), "down": size(p[2], p[3], p[0], p[1]), "area": area}).where("down > 0")
    return quad.select("page_id", *whole, F.round("across", 6).alias("across"), F.round("down", 6).alias("down"), F.round(F.col("across") / F.col("down"), 6).alias("aspect"), "area")


#: What a request says of a page, from its number: a direction or none, a target language, an alignment or none.
ASKED_SQL = """CASE page_id % 6 WHEN 0 THEN 'h' WHEN 1 THEN 'vr' ELSE 'auto' END AS asked, CASE page_id % 4 WHEN 0 THEN 'ARA' WHEN 1 THEN 'JPN' WHEN 2 THEN 'CHS' ELSE 'XXX' END AS lang, CASE page_id % 5 WHEN 0 THEN 'right' ELSE 'auto' END AS align"""
DIRECTION_SQL = f"""{LINES_SQL}, r AS (SELECT page_id, w, h, count(*) OVER (PARTITION BY page_id) AS n, {ASKED_SQL}, row_number() OVER (PARTITION BY page_id ORDER BY w * h DESC, line_id) AS nth FROM lines),
preset(code, way) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ORIENTATION.items())}),
d AS (SELECT page_id, n, align, CASE WHEN asked IN ('h', 'v', 'hr', 'vr') THEN asked WHEN way IN ('h', 'v', 'hr', 'vr') THEN way WHEN CAST(w AS DOUBLE) / h < 1 THEN 'v' ELSE 'h' END AS direction FROM r LEFT JOIN preset ON code = lang WHERE nth = 1)"""


def directed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, n, align, direction: the direction asked for, else the language's, else by the shape of the largest line, the first of equals."""
    shape = F.min_by(F.when(F.col("w") / F.col("h") < 1, "v").otherwise("h"), F.struct(-(F.col("w") * F.col("h")), F.col("line_id")))
    pages = text_lines(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"), shape.alias("shape"))
    pages = pages.select("page_id", "n", "shape", *[F.expr(x) for x in ASKED_SQL.split(", CASE")[:1]], *[F.expr(f"CASE{x}") for x in ASKED_SQL.split(", CASE")[1:]])
    preset = F.element_at(F.create_map(*[F.lit(x) for kv in ORIENTATION.items() for x in kv]), F.col("lang"))
    known = lambda c: F.when(c.isin("h", "v", "hr", "vr"), c)
    return pages.select("page_id", "n", "align", F.coalesce(known(F.col("asked")), known(preset), F.col("shape")).alias("direction"))


@query("G13_direction", f"WITH {DIRECTION_SQL} SELECT page_id, direction FROM d")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed_pages(spark, sf_dir).select("page_id", "direction")


@query("G14_alignment", f"WITH {DIRECTION_SQL} SELECT page_id, CASE WHEN align IN ('left', 'center', 'right') THEN align WHEN n = 1 OR direction = 'h' THEN 'center' WHEN direction = 'hr' THEN 'right' ELSE 'left' END AS alignment FROM d")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As asked for; else single lines and left-to-right text in the middle, right-to-left lines on the right, the others on the left."""
    pages, way = directed_pages(spark, sf_dir), F.col("direction")
    chosen = F.when(F.col("align").isin("left", "center", "right"), F.col("align")).when((F.col("n") == 1) | (way == "h"), "center").when(way == "hr", "right").otherwise("left")
    return pages.select("page_id", chosen.alias("alignment"))


#: A second colour of each line, more or less like the first.
GROUND_SQL = "(fg_r + line_id * 9) % 256 AS bg_r, (fg_g + line_id * line_id * 5) % 256 AS bg_g, (fg_b + line_id * 3) % 256 AS bg_b"


def _lab_sql(r: str, g: str, b: str) -> str:
    """A scalar subquery with the list [L, a, b] of a colour."""
    linear = [f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END" for c in (r, g, b)]
    sums = [" + ".join(f"{k}::DOUBLE * ({c})" for k, c in zip(row, linear)) for row in G.XYZ]
    x, y, z = f"({sums[0]}) / {G.WHITE[0]}::DOUBLE", f"({sums[1]})", f"({sums[2]}) / {G.WHITE[1]}::DOUBLE"
    f = lambda t: f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END)"
    light = f"(CASE WHEN {y} > 0.008856 THEN 116 * {f(y)} - 16 ELSE 903.3::DOUBLE * {y} END) * 255 / 100"
    return "[" + ", ".join(f"greatest(0, least(255, round({v}, 0)))" for v in (light, f"500 * ({f(x)} - {f(y)}) + 128", f"200 * ({f(y)} - {f(z)}) + 128")) + "]"


DIFFERENCE_SQL = f"""{LINES_SQL}, coloured AS (SELECT *, {GROUND_SQL} FROM lines),
labs AS (SELECT *, {_lab_sql("fg_r", "fg_g", "fg_b")} AS p, {_lab_sql("bg_r", "bg_g", "bg_b")} AS q FROM coloured),
differences AS (SELECT *, sqrt(pow({G.LIGHTNESS}::DOUBLE * (p[1] - q[1]), 2) + pow(p[2] - q[2], 2) + pow(p[3] - q[3], 2)) AS difference FROM labs)"""


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with bg_r, bg_g, bg_b and the difference of the two colours."""
    k = F.col("line_id")
    lines = text_lines(spark, sf_dir).withColumns({"bg_r": (F.col("fg_r") + k * 9) % 256, "bg_g": (F.col("fg_g") + k * k * 5) % 256, "bg_b": (F.col("fg_b") + k * 3) % 256})
    return lines.withColumn("difference", G.color_difference(G.cols("fg_r", "fg_g", "fg_b"), G.cols("bg_r", "bg_g", "bg_b")))


@query("G15_color_difference", f"WITH {DIFFERENCE_SQL} SELECT page_id, line_id, round(difference, 5) AS difference FROM differences")
def color_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloured(spark, sf_dir).select("page_id", "line_id", F.round("difference", 5).alias("difference"))


@query(
    "G16_contrast",
    f"""WITH {DIFFERENCE_SQL} SELECT page_id, line_id, CASE WHEN difference < 30 THEN CASE WHEN (fg_r + fg_g + fg_b) / 3.0 <= 127 THEN 255 ELSE 0 END ELSE bg_r END AS r,
CASE WHEN difference < 30 THEN CASE WHEN (fg_r + fg_g + fg_b) / 3.0 <= 127 THEN 255 ELSE 0 END ELSE bg_g END AS g, CASE WHEN difference < 30 THEN CASE WHEN (fg_r + fg_g + fg_b) / 3.0 <= 127 THEN 255 ELSE 0 END ELSE bg_b END AS b, difference > 15 AS stroked FROM differences""",
)
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ground too like its letters becomes white or black; letters are stroked unless the colours are nearly the same."""
    plain = F.when((F.col("fg_r") + F.col("fg_g") + F.col("fg_b")) / 3 <= 127, 255).otherwise(0)
    fixed = [F.when(F.col("difference") < 30, plain).otherwise(F.col(f"bg_{c}")).alias(c) for c in "rgb"]
    return coloured(spark, sf_dir).select("page_id", "line_id", *fixed, (F.col("difference") > 15).alias("stroked"))


@query(
    "G17_bubble_confidence",
    f"""WITH {LINES_SQL}, b AS (SELECT page_id, line_id, w * h * (1 + line_id % 5) AS flood, w * h AS area, prob, w + line_id % 7 - 3 AS bw, h + line_id % 5 - 2 AS bh, w, h FROM lines)
SELECT page_id, line_id, round(0.45 * greatest(0.0, least(1.0, (CAST(flood AS DOUBLE) / greatest(area, 1) - 1.0) / 4.0)) + 0.30 * greatest(0.0, least(1.0, prob)) + 0.25 * (0.5 * greatest(0.0, least(1.0, CAST(bw AS DOUBLE) / greatest(w, 1))) + 0.5 * greatest(0.0, least(1.0, CAST(bh AS DOUBLE) / greatest(h, 1)))), 9) AS score FROM b""",
)
def bubble_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, k = G.cols("w", "h", "line_id")
    return each_line(spark, sf_dir, score=F.round(G.bubble_confidence(w * h * (1 + k % 5), w * h, F.col("prob"), w + k % 7 - 3, h + k % 5 - 2, w, h), 9))


@query(
    "G18_padding",
    f"""WITH {LINES_SQL}, d AS (SELECT page_id, line_id, w, h, length(text) AS chars, greatest(1.0, sqrt(CAST(greatest(w * h * 3, 1) AS DOUBLE))) AS dim FROM lines)
SELECT page_id, line_id, greatest(3, least(24, greatest(3, CAST(trunc(CAST(least(w, h) * 0.22 AS DOUBLE)) AS BIGINT)), CAST(round_even((0.45 * 8.0 + 0.55 * (0.06 * dim)) * greatest(0.72, least(1.12, 1.06 - 0.16 * (chars / dim))), 0) AS BIGINT))) AS padding FROM d""",
)
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.cols("w", "h")
    return each_line(spark, sf_dir, padding=G.adaptive_padding(w * h * 3, w, h, F.length("text"), F.lit(8.0)))


@query("G19_fallback_cap", f"WITH {LINES_SQL} SELECT page_id, line_id, round(CASE WHEN prob < 0.25 THEN 2.5 WHEN prob < 0.45 THEN 2.2 WHEN prob < 0.65 THEN 1.9 WHEN prob < 0.80 THEN 1.7 ELSE 1.5 END + CASE WHEN line_id > 2 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS cap FROM lines")
def fallback_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_line(spark, sf_dir, cap=F.round(G.fallback_cap(F.col("prob"), F.col("line_id").cast("double")), 4))


@query("G20_early_bias", f"WITH {LINES_SQL} SELECT page_id, line_id, CASE WHEN prob - 0.5 < 0.20 AND line_id > 1.2 THEN 1.2 WHEN prob - 0.5 < 0.30 AND line_id > 1.6 THEN 1.1 ELSE 1.0 END::DOUBLE AS bias FROM lines")
def early_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_line(spark, sf_dir, bias=G.early_bias(F.col("prob") - 0.5, F.col("line_id").cast("double")))


@query("G25_quads", f"WITH {LINES_SQL} SELECT page_id, line_id, x + w AS x2, y + h AS y2, x AS x3, y + h AS y3 FROM lines")
def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = G.cols(*"xywh")
    return each_line(spark, sf_dir, x2=x + w, y2=y + h, x3=x, y3=y + h)


@query(
    "G25_ordered_points",
    f"""WITH {MIXED_SQL}, c AS (SELECT page_id, line_id, unnest(p) AS q FROM mixed)
SELECT page_id, line_id, min_by(q.x, [q.x + q.y, q.x]) AS x1, min_by(q.y, [q.x + q.y, q.x]) AS y1, min_by(q.x, [q.y - q.x, q.x]) AS x2, min_by(q.y, [q.y - q.x, q.x]) AS y2,
max_by(q.x, [q.x + q.y, q.x]) AS x3, max_by(q.y, [q.x + q.y, q.x]) AS y3, max_by(q.x, [q.y - q.x, q.x]) AS x4, max_by(q.y, [q.y - q.x, q.x]) AS y4 FROM c GROUP BY page_id, line_id""",
)
def ordered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sum and difference of the coordinates: least sum, least difference, largest sum, largest difference."""
    ranked = lambda key: F.array_sort(F.transform("p", lambda q: F.struct(key(q).alias("k"), q["x"].alias("x"), q["y"].alias("y"))))
    df = mixed_corners(spark, sf_dir).withColumns({"total": ranked(lambda q: q["x"] + q["y"]), "apart": ranked(lambda q: q["y"] - q["x"])})
    corner = lambda c, at, n: [F.col(c)[at]["x"].alias(f"x{n}"), F.col(c)[at]["y"].alias(f"y{n}")]
    return df.select("page_id", "line_id", *corner("total", 0, 1), *corner("apart", 0, 2), *corner("total", 3, 3), *corner("apart", 3, 4))


BENT_SQL = f"""{LINES_SQL}, bent AS (SELECT page_id, line_id, x AS x1, y AS y1, x + w AS x2, y + line_id % 3 AS y2, x + w - (line_id * 17) % 60 AS x3, y + h AS y3, x AS x4, y + h - (line_id * 11) % 40 AS y4, x, y, w, h, (line_id * 13) % 100 - 50 AS angle FROM lines)"""
_TURNS = [f"((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}))" for a, b, c in ((1, 2, 3), (2, 3, 4), (3, 4, 1), (4, 1, 2))]


@query(
    "G26_sound_quads",
    f"""WITH {BENT_SQL}, judged AS (SELECT *, abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2.0 < 20
  OR NOT (least({", ".join(_TURNS)}) >= 0 OR greatest({", ".join(_TURNS)}) <= 0)
  OR least({", ".join(f"power(x{b} - x{a}, 2) + power(y{b} - y{a}, 2)" for a, b in ((1, 2), (2, 3), (3, 4), (4, 1)))}) < 16 AS poor FROM bent),
held AS (SELECT page_id, line_id, angle, CASE WHEN poor THEN x ELSE x1 END::DOUBLE AS px, CASE WHEN poor THEN y ELSE y1 END::DOUBLE AS py, CASE WHEN poor THEN x + w ELSE x2 END::DOUBLE AS qx, CASE WHEN poor THEN y ELSE y2 END::DOUBLE AS qy,
  CASE WHEN poor THEN x + w ELSE x3 END::DOUBLE AS rx, CASE WHEN poor THEN y + h ELSE y3 END::DOUBLE AS ry, CASE WHEN poor THEN x ELSE x4 END::DOUBLE AS sx, CASE WHEN poor THEN y + h ELSE y4 END::DOUBLE AS sy FROM judged),
turned AS (SELECT *, radians(CASE WHEN abs(angle) > 10 AND abs(angle) < 45 AND abs(degrees(atan2(qy - py, qx - px))) < 3 THEN greatest(-10, least(10, angle * 0.35::DOUBLE)) ELSE 0 END) AS t, (px + qx + rx + sx) / 4 AS mx, (py + qy + ry + sy) / 4 AS my FROM held)
SELECT page_id, line_id, {", ".join(f"round(mx + ({k}x - mx) * cos(t) - ({k}y - my) * sin(t), 4) + 0.0 AS {k}x, round(my + ({k}x - mx) * sin(t) + ({k}y - my) * cos(t), 4) + 0.0 AS {k}y" for k in "pqrs")} FROM turned""",
)
def sound_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one corner pulled in and one pulled up, some out of shape."""
    x, y, w, h, k = G.cols(*"xywh", "line_id")
    bent = [(x, y), (x + w, y + k % 3), (x + w - k * 17 % 60, y + h), (x, y + h - k * 11 % 40)]
    quad = G.sound_quad(bent, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], k * 13 % 100 - 50)
    return each_line(spark, sf_dir, **{f"{name}{c}": F.round(v, 4) + F.lit(0.0) for name, corner in zip("pqrs", quad) for c, v in zip("xy", corner)})


#: Two regions, a line and the next one of its page, that share the bubble round the first.
SHARED_SQL = f"""{LINES_SQL}, shared AS (SELECT a.page_id, a.line_id, a.x - 8 AS ox, a.y - 8 AS oy, a.w + 16 AS ow, a.h + 16 AS oh, a.x + a.w / 2.0 AS cxi, a.y + a.h / 2.0 AS cyi, b.x + b.w / 2.0 AS cxj, b.y + b.h / 2.0 AS cyj {NEXT_SQL})"""


@query(
    "G27_bubble_split",
    f"""WITH {SHARED_SQL}, c AS (SELECT *, abs(cxi - cxj) > abs(cyi - cyj) AS across, greatest(ox + 10, least(CAST(trunc((cxi + cxj) / 2) AS BIGINT), ox + ow - 10)) AS sx, greatest(oy + 10, least(CAST(trunc((cyi + cyj) / 2) AS BIGINT), oy + oh - 10)) AS sy FROM shared),
f AS (SELECT *, CASE WHEN across THEN cxi <= cxj ELSE cyi <= cyj END AS leads FROM c)
SELECT page_id, line_id, CASE WHEN across AND NOT leads THEN sx ELSE ox END AS x, CASE WHEN NOT across AND NOT leads THEN sy ELSE oy END AS y,
CASE WHEN NOT across THEN ow WHEN leads THEN sx - ox ELSE ox + ow - sx END AS w, CASE WHEN across THEN oh WHEN leads THEN sy - oy ELSE oy + oh - sy END AS h FROM f""",
)
def bubble_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a shared bubble that stays with its first region: cut half-way between the centres, along the axis on which they are further apart, 10 pixels from the edge at least."""
    lines = text_lines(spark, sf_dir)
    x, y, w, h = G.cols(*"xywh")
    middle = lambda k: [(x + w / 2).alias(f"cx{k}"), (y + h / 2).alias(f"cy{k}")]
    mine = lines.select("page_id", "line_id", (x - 8).alias("bx"), (y - 8).alias("by"), (w + 16).alias("bw"), (h + 16).alias("bh"), *middle("i"))
    df = mine.join(lines.select("page_id", (F.col("line_id") - 1).alias("line_id"), *middle("j")), ["page_id", "line_id"])
    across = F.abs(F.col("cxi") - F.col("cxj")) > F.abs(F.col("cyi") - F.col("cyj"))
    cut = lambda c, low, size: F.greatest(F.col(low) + 10, F.least(((F.col(f"c{c}i") + F.col(f"c{c}j")) / 2).cast("long"), F.col(low) + F.col(size) - 10))
    df = df.withColumns({"across": across, "sx": cut("x", "bx", "bw"), "sy": cut("y", "by", "bh")})
    df = df.withColumn("leads", F.when(F.col("across"), F.col("cxi") <= F.col("cxj")).otherwise(F.col("cyi") <= F.col("cyj")))
    part = lambda along, low, size, at: (F.when(along & ~F.col("leads"), F.col(at)).otherwise(F.col(low)), F.when(~along, F.col(size)).when(F.col("leads"), F.col(at) - F.col(low)).otherwise(F.col(low) + F.col(size) - F.col(at)))
    px, pw = part(F.col("across"), "bx", "bw", "sx")
    py, ph = part(~F.col("across"), "by", "bh", "sy")
    return df.select("page_id", "line_id", px.alias("x"), py.alias("y"), pw.alias("w"), ph.alias("h"))


@query("G30_extended_rect", f"WITH {LINES_SQL} SELECT page_id, line_id, greatest(x - 6, 0) AS x1, greatest(y - 6, 0) AS y1, least(w + 12, 240 - greatest(x - 6, 0) - 1) AS w1, least(h + 12, 240 - greatest(y - 6, 0) - 1) AS h1 FROM lines")
def extended_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = G.cols(*"xywh")
    x1, y1 = F.greatest(x - 6, F.lit(0)), F.greatest(y - 6, F.lit(0))
    return each_line(spark, sf_dir, x1=x1, y1=y1, w1=F.least(w + 12, 240 - x1 - 1), h1=F.least(h + 12, 240 - y1 - 1))


@query("G31_mask_scale", f"WITH i AS ({IMAGE_SQL}) SELECT p_partkey, round(greatest(0.5, least(1.0, (h - w / 3.0) / h)), 8)::DOUBLE AS scale FROM i")
def mask_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("p_partkey", F.round(G.clamp((F.col("h") - F.col("w") / 3) / F.col("h"), 0.5, 1.0), 8).alias("scale"))


@query("G32_padded_size", f"WITH i AS ({IMAGE_SQL}) SELECT p_partkey, CAST(ceil(w / 256.0) AS BIGINT) * 256 AS w256, CAST(ceil(h / 8.0) AS BIGINT) * 8 AS h8, CAST(4 * floor((w + 7) / 4.0) AS BIGINT) AS crop FROM i")
def padded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.cols("w", "h")
    return images(spark, sf_dir).select("p_partkey", (F.ceil(w / 256) * 256).alias("w256"), (F.ceil(h / 8) * 8).alias("h8"), (4 * F.floor((w + 7) / 4)).alias("crop"))


#: Sizes that the steps of a page image's way ask for: detection and inpainting.
DETECT, INPAINT = 1536, 800


@query(
    "G32_resized",
    f"""WITH i AS ({IMAGE_SQL}), r AS (SELECT p_partkey, w, h, {DETECT}::DOUBLE / greatest(w, h) AS ratio, {INPAINT}::DOUBLE / greatest(w, h) AS keep FROM i),
t AS (SELECT *, CAST(round_even(w * ratio, 0) AS BIGINT) AS tw, CAST(round_even(h * ratio, 0) AS BIGINT) AS th, CASE WHEN greatest(w, h) > {INPAINT} THEN CAST(round_even(w * keep, 0) AS BIGINT) ELSE w END AS kw, CASE WHEN greatest(w, h) > {INPAINT} THEN CAST(round_even(h * keep, 0) AS BIGINT) ELSE h END AS kh FROM r)
SELECT p_partkey, round(ratio, 8) AS ratio, (256 - tw % 256) % 256 AS pad_w, (256 - th % 256) % 256 AS pad_h, (tw + (256 - tw % 256) % 256) // 2 AS heat_w, (th + (256 - th % 256) % 256) // 2 AS heat_h,
CAST(round_even(abs(w - h) / greatest(1.0::DOUBLE, CAST(greatest(w, h) AS DOUBLE) / {DETECT}), 0) AS BIGINT) AS square_pad, kw + (8 - kw % 8) % 8 AS inpaint_w, kh + (8 - kh % 8) % 8 AS inpaint_h FROM t""",
)
def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and padding to 256 for detection and its heat map, what a square pads, and the inpainter's size in eights."""
    w, h = G.cols("w", "h")
    longer = F.greatest(w, h)
    whole = lambda c: F.bround(c).cast("long")
    pad = lambda c, to: (to - c % to) % to
    ratio, keep = F.lit(float(DETECT)) / longer, F.lit(float(INPAINT)) / longer
    df = images(spark, sf_dir).withColumns({"ratio": ratio, "tw": whole(w * ratio), "th": whole(h * ratio), "kw": F.when(longer > INPAINT, whole(w * keep)).otherwise(w), "kh": F.when(longer > INPAINT, whole(h * keep)).otherwise(h)})
    tw, th, kw, kh = G.cols("tw", "th", "kw", "kh")
    return df.select(
        "p_partkey", F.round("ratio", 8).alias("ratio"), pad(tw, 256).alias("pad_w"), pad(th, 256).alias("pad_h"), F.floor((tw + pad(tw, 256)) / 2).alias("heat_w"), F.floor((th + pad(th, 256)) / 2).alias("heat_h"),
        whole(F.abs(w - h) / F.greatest(F.lit(1.0), longer / DETECT)).alias("square_pad"), (kw + pad(kw, 8)).cast("long").alias("inpaint_w"), (kh + pad(kh, 8)).cast("long").alias("inpaint_h"),
    )


def base_quad(box: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners (x1, y1 to x4, y4) to place a text in: those of an inpaint box, given as an object, a list of four or four points, else of the region.

    Boxes of 2 pixels or less in a direction, and what is none of these, are passed over.
    """
    named, listed, points = F.from_json(box, "x int, y int, w int, h int"), F.from_json(box, "array<int>"), F.from_json(box, "array<array<int>>")
    corners = lambda a, b, c, d: F.array(*[v.cast("long") for v in (a, b, a + c, b, a + c, b + d, a, b + d)])
    item = lambda k: F.get(listed, F.lit(k))
    by_name = F.when((named["w"] > 2) & (named["h"] > 2), corners(named["x"], named["y"], named["w"], named["h"]))
    by_place = F.when((F.size(listed) == 4) & (item(2) > 2) & (item(3) > 2), corners(item(0), item(1), item(2), item(3)))
    four = (F.size(points) == 4) & F.forall(points, lambda p: F.size(p) == 2)
    by_points = F.when(four, F.flatten(points).cast("array<long>"))
    opens = F.substring(F.trim(box), 1, 2)
    return F.coalesce(F.when(F.startswith(opens, F.lit("{")), by_name), F.when(opens == "[[", by_points), F.when(F.startswith(opens, F.lit("[")), by_place), corners(x, y, w, h))


@query(
    "G25_base_quads",
    f"""WITH {LINES_SQL}, k AS (SELECT page_id, line_id, x, y, w, h, line_id % 5 AS kind FROM lines),
b AS (SELECT *, CASE WHEN kind = 0 AND w % 9 > 2 AND h > 2 THEN [x + 1, y, x + 1 + w % 9, y, x + 1 + w % 9, y + h, x + 1, y + h] WHEN kind = 1 AND w > 2 AND h % 7 > 2 THEN [x, y, x + w, y, x + w, y + h % 7, x, y + h % 7]
WHEN kind = 2 THEN [x, y, x + w, y, x + w, y + h, x, y + h + 3] ELSE [x, y, x + w, y, x + w, y + h, x, y + h] END AS q FROM k)
SELECT page_id, line_id, array_to_string(q, ',') AS quad FROM b""",
)
def base_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's quad, from an inpaint box of one of three forms where it has one that is large enough."""
    x, y, w, h, k = G.cols(*"xywh", "line_id")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    named = text('{"x": ', x + 1, ', "y": ', y, ', "w": ', w % 9, ', "h": ', h, "}")
    listed = text("[", x, ", ", y, ", ", w, ", ", h % 7, "]")
    points = text("[[", x, ",", y, "],[", x + w, ",", y, "],[", x + w, ",", y + h, "],[", x, ",", y + h + 3, "]]")
    box = F.when(k % 5 == 0, named).when(k % 5 == 1, listed).when(k % 5 == 2, points).when(k % 5 == 3, "none")
    return each_line(spark, sf_dir, quad=F.array_join(base_quad(box, x, y, w, h), ","))


@query("G33_rescaled", f"WITH {LINES_SQL} SELECT page_id, line_id, x * 1.5::DOUBLE AS x, y * 2.5::DOUBLE AS y FROM lines")
def rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_line(spark, sf_dir, x=F.col("x") * F.lit(1.5), y=F.col("y") * F.lit(2.5))


@query("G34_unclip", f"WITH {LINES_SQL} SELECT page_id, line_id, round(CAST(w * h AS DOUBLE) * CAST(2.3 AS DOUBLE) / (2 * (w + h)), 4) AS distance FROM lines")
def unclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.cols("w", "h")
    return each_line(spark, sf_dir, distance=F.round(w * h * F.lit(2.3) / (2 * (w + h)), 4))


@query("G36_overflow", f"WITH {LINES_SQL}, {METRICS_SQL} SELECT page_id, line_id, round(overflow_w, 6) AS overflow_w, round(overflow_h, 6) AS overflow_h, round(shrink, 6) AS shrink, CAST(centering AS BIGINT) AS centering FROM metrics")
def overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's overflow, shrink and centring of each line, lines counted by the text's length."""
    rows = region_metrics(text_lines(spark, sf_dir))
    return rows.select("page_id", "line_id", *[F.round(c, 6).alias(c) for c in ("overflow_w", "overflow_h", "shrink")], F.col("centering").cast("long"))


@query("G37_gamma", f"WITH {LINES_SQL} SELECT page_id, round(ln(127.5) / ln(avg(fg_r) + 1e-6::DOUBLE), 5) AS gamma FROM lines GROUP BY page_id")
def gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("page_id").agg(F.round(F.log(F.lit(127.5)) / F.log(F.avg("fg_r") + 1e-6), 5).alias("gamma"))


@query("G38_inclusive_size", f"WITH {LINES_SQL} SELECT page_id, line_id, greatest(1, w + 1) AS bw, greatest(1, h + 1) AS bh FROM lines")
def inclusive_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle on whole points holds both ends, hence one more."""
    return each_line(spark, sf_dir, bw=F.greatest(F.lit(1), F.col("w") + 1), bh=F.greatest(F.lit(1), F.col("h") + 1))
