"""Lines at an angle: shapes, distances and merge pairs of general quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellum.functions import geometry as G
from vellum.operators import quads as Q, regions as R
from vellum.queries.registry import query
from vellum.sources.layout import LINES_SQL, text_lines
from vellum.sources.scratch import Scratch

#: Lines turned about their middle, by an angle of the page and a little of the line; corners on whole pixels.
TURN_SQL = "radians((page_id % 5) * 12 - 24 + (line_id % 2) * 4)"


def _corner_sql(sx: str, sy: str) -> str:
    dx, dy = f"({sx} w / 2.0::DOUBLE)", f"({sy} h / 2.0::DOUBLE)"
    return f"{{'x': round(x + w / 2.0::DOUBLE + {dx} * cos(t) - {dy} * sin(t), 0), 'y': round(y + h / 2.0::DOUBLE + {dx} * sin(t) + {dy} * cos(t), 0)}}"


def _least_sql(p: str, ring: str) -> str:
    """The least square distance of a point of ``p`` from an edge of ``ring``."""
    dx, dy = "(e.b.x - e.a.x)", "(e.b.y - e.a.y)"
    along = f"greatest(0, least(1, ((v.x - e.a.x) * {dx} + (v.y - e.a.y) * {dy}) / greatest({dx} * {dx} + {dy} * {dy}, 1e-12)))"
    return f"list_min(flatten(list_transform({p}, lambda v: list_transform({ring}, lambda e: pow(v.x - e.a.x - {along} * {dx}, 2) + pow(v.y - e.a.y - {along} * {dy}, 2)))))"


def _span_sql(of: str, p: str) -> str:
    return f"{of}(list_transform({p}, lambda v: v.x * (e.a.y - e.b.y) + v.y * (e.b.x - e.a.x)))"


_APART_SQL = f"len(list_filter(list_concat(a.ring, b.ring), lambda e: {_span_sql('list_max', 'a.p')} < {_span_sql('list_min', 'b.p')} OR {_span_sql('list_max', 'b.p')} < {_span_sql('list_min', 'a.p')})) > 0"
GAP_SQL = f"CASE WHEN {_APART_SQL} THEN sqrt(least({_least_sql('a.p', 'b.ring')}, {_least_sql('b.p', 'a.ring')})) ELSE 0 END"
_MIDDLE = "trunc((p[{i}].{c} + p[{j}].{c}) / 2)"
_VECTORS = {n: f"{_MIDDLE.format(i=i, j=j, c=c)} - {_MIDDLE.format(i=k, j=m, c=c)}" for n, i, j, k, m, c in (("vx", 3, 4, 1, 2, "x"), ("vy", 3, 4, 1, 2, "y"), ("ux", 4, 1, 2, 3, "x"), ("uy", 4, 1, 2, 3, "y"))}
TILTED_SQL = f"""{LINES_SQL}, turned AS (SELECT *, {TURN_SQL} AS t FROM lines),
quads AS (SELECT page_id, line_id, [{", ".join(_corner_sql(*s) for s in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+")))}] AS p FROM turned),
vectors AS (SELECT page_id, line_id, p, [{", ".join(f"{{'a': p[{k}], 'b': p[{k % 4 + 1}]}}" for k in (1, 2, 3, 4))}] AS ring, {", ".join(f"{v} AS {n}" for n, v in _VECTORS.items())}, list_transform(p, lambda v: v.x) AS xs, list_transform(p, lambda v: v.y) AS ys FROM quads),
shapes AS (SELECT page_id, line_id, p, ring, sqrt(vx * vx + vy * vy) AS tall, sqrt(ux * ux + uy * uy) AS wide, atan2(vx, vy) AS angle, list_min(xs) AS x, list_min(ys) AS y, list_max(xs) - list_min(xs) AS w, list_max(ys) - list_min(ys) AS h FROM vectors),
shaped AS (SELECT *, least(tall, wide) AS font, wide / tall AS aspect FROM shapes)"""


def tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, line_id, p (corners in ring order) and the columns of :func:`~vellum.functions.geometry.quad_shape`."""
    x, y, w, h, k = G.cols(*"xywh", "line_id")
    t = F.radians(F.col("page_id") % 5 * 12 - 24 + k % 2 * 4)
    cx, cy = x + w / 2, y + h / 2

    def corner(sx: int, sy: int) -> object:
        dx, dy = sx * w / 2, sy * h / 2
        return F.struct(F.round(cx + dx * F.cos(t) - dy * F.sin(t), 0).alias("x"), F.round(cy + dx * F.sin(t) + dy * F.cos(t), 0).alias("y"))

    quads = text_lines(spark, sf_dir).select("page_id", "line_id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("p"))
    return quads.select("*", *[c.alias(n) for n, c in G.quad_shape(F.col("p")).items()])


@query("G3_tilted_shape", f"WITH {TILTED_SQL} SELECT page_id, line_id, round(aspect, 7) AS aspect, round(font, 7) AS font, round(angle, 7) + 0.0 AS angle, CAST(w * h AS DOUBLE) AS bounds FROM shaped")
def tilted_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round("aspect", 7).alias("aspect"), F.round("font", 7).alias("font"), (F.round("angle", 7) + F.lit(0.0)).alias("angle")]
    return tilted(spark, sf_dir).select("page_id", "line_id", *rounded, (F.col("w") * F.col("h")).alias("bounds"))


def followed(quads: DataFrame) -> DataFrame:
    """page_id, line_id, p of each line and q of the next one of its page."""
    page = Window.partitionBy("page_id").orderBy("line_id")
    both = quads.select("page_id", "line_id", "p", F.lead("p").over(page).alias("q"), F.lead("line_id").over(page).alias("next"))
    return both.where("next = line_id + 1").drop("next")


@query("G7_quad_gap", f"WITH {TILTED_SQL} SELECT a.page_id, a.line_id AS src, b.line_id AS dst, round({GAP_SQL}, 5) AS gap FROM shaped a JOIN shaped b ON a.page_id = b.page_id AND b.line_id = a.line_id + 1")
def quad_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line and the next one of its page."""
    near = Q.with_figures(followed(tilted(spark, sf_dir)), "gap double", lambda b: [Q.gaps(Q.rings(b, "p"), Q.rings(b, "q"))], drop=("p", "q"))
    return near.select("page_id", F.col("line_id").alias("src"), (F.col("line_id") + 1).alias("dst"), F.round("gap", 5).alias("gap"))


_LIMIT = "15 * pi() / 180"


@query(
    "J1_tilted_pairs",
    f"""WITH {TILTED_SQL}, pairs AS (SELECT a.page_id, a.line_id AS src, b.line_id AS dst, {GAP_SQL} AS gap, least(a.font, b.font) AS size, greatest(a.font, b.font) AS largest, a.aspect AS sa, b.aspect AS sb, a.angle AS ta, b.angle AS tb,
  abs(a.x + floor(a.w / 2) - (b.x + floor(b.w / 2))) AS centres, a.w > a.h * 1.9 AS wa, b.w > b.h * 1.9 AS wb, a.h > a.w * 1.9 AS la, b.h > b.w * 1.9 AS lb, least(abs(a.x - b.x), abs(a.x + a.w - b.x - b.w)) AS sides, least(abs(a.y - b.y), abs(a.y + a.h - b.y - b.h)) AS ends
  FROM shaped a JOIN shaped b ON a.page_id = b.page_id AND a.line_id < b.line_id)
SELECT page_id, src, dst, round(gap, 5) AS gap FROM pairs WHERE gap <= 2 * size AND largest / size <= {R.MERGE["fonts"]} AND NOT (sa > {R.MERGE["aspect"]} AND sb < 1 / {R.MERGE["aspect"]}::DOUBLE) AND NOT (sb > {R.MERGE["aspect"]} AND sa < 1 / {R.MERGE["aspect"]}::DOUBLE)
AND CASE WHEN abs(ta) < {_LIMIT} AND abs(tb) < {_LIMIT} THEN gap < size * {R.MERGE["gap"]} AND (centres < {R.MERGE["gap2"]} OR (NOT (wa AND lb) AND NOT (wb AND la) AND CASE WHEN wa OR wb THEN sides < size * {R.MERGE["gap2"]} WHEN la OR lb THEN ends < size * {R.MERGE["gap2"]} ELSE FALSE END))
ELSE abs(ta - tb) < {_LIMIT} AND gap <= size * {R.MERGE["gap2"]} AND (largest - size) / size <= 0.25 END""",
)
def tilted_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge pairs with the branch for lines at an angle."""
    good = R.tilted_pairs(tilted(spark, sf_dir))
    return good.select("page_id", F.col("a_line_id").alias("src"), F.col("b_line_id").alias("dst"), F.round("gap", 5).alias("gap"))


@query("J10_tilted_regions")
def tilted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of tilted lines: pairs also need nearly the same direction."""
    with Scratch(spark, "tilted-regions") as scratch:
        return R.tilted_regions(tilted(spark, sf_dir), scratch)
