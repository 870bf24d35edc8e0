"""Score maps of a detector to boxes, and the shapes that this takes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.operators import contours as C, quads as Q
from vellum.operators.frames import Stack, over_frames, remainder, rounded
from vellum.queries.registry import query
from vellum.queries.tilted import TILTED_SQL, followed, tilted
from vellum.sources.tables import read_table

#: Thresholds of pixel and box in 255ths, and how far a box is widened.
PIXEL, BOX, RATIO = 153, 178.5, 2.2


def maps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, and the directions of two bars on each map."""
    k, size = F.col("p_partkey"), F.col("p_size")
    maps = read_table(spark, sf_dir, "part").select(k.alias("image_id"), (36 + size % 9).cast("int").alias("w"), (28 + k % 7).cast("int").alias("h"))
    i = F.col("image_id")
    one, two = F.radians(i % 12 * 15), F.radians(i % 7 * 25)
    return maps.withColumns({"cos_one": F.cos(one), "sin_one": F.sin(one), "cos_two": F.cos(two), "sin_two": F.sin(two)})


def score(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two bars at an angle, one with a hole, scores from 0 to 255."""
    i = c["image_id"]

    def bar(cx: np.ndarray, cy: float, turn: str, long: np.ndarray, thick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos, sin = c[f"cos_{turn}"], c[f"sin_{turn}"]
        u, v = np.abs((x - cx) * cos + (y - cy) * sin), np.abs((y - cy) * cos - (x - cx) * sin)
        return (u < long) & (v < thick), (u < 2.5) & (v < 1.5)

    one, hole = bar(c["w"] / 3, 10.0, "one", 6.0 + i % 4, 3.0 + i % 3)
    two, _ = bar(c["w"] * 0.7, 20.0, "two", 5.0 + i % 5, 1.0 + i % 4)
    return remainder(x * 3, y * 5 + i, 40) + np.where(one & ~(hole & (i % 2 == 0)), np.int16(215), np.where(two, np.int16(150), np.int16(0)))


@query("K15_contour_boxes")
def contour_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each score map, in an image twice its size, with their mean scores."""

    def each(s: Stack) -> list:
        maps, means, corners = C.boxes_of(s.grey, s.w, s.h, PIXEL, BOX, RATIO, 2 * s.w, 2 * s.h)
        return [s.image_id[maps], C.numbered(maps), rounded(means / 255), *corners.reshape(-1, 8).T]

    return over_frames(maps_of(spark, sf_dir), "image_id bigint, box int, score double, " + ", ".join(f"{c}{k} bigint" for k in range(1, 5) for c in "xy"), each, score)


@query("P6_candidate_boxes")
def candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes each map keeps, and their best score, from :func:`contour_boxes`."""
    return contour_boxes(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("boxes"), F.max("score").alias("best"))


@query("G35_borders")
def border_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each border's length in points, the sides of its least rectangle, the rectangle's first corner, and the mean score inside."""

    def each(s: Stack) -> list:
        of = C.borders_of((s.grey > PIXEL) & s.inside())
        corners, short, long = C.rectangles_of(of)
        first = C.first_corners(corners) + 0.0
        return [s.image_id[of.mask], C.numbered(of.mask), of.size, *map(rounded, (short, long, *first.T, C.means_of(s.grey, of)))]

    return over_frames(maps_of(spark, sf_dir), "image_id bigint, border int, points int, short double, long double, x double, y double, score double", each, score)


_STEP = f"2 * acos(greatest(0.0::DOUBLE, 1 - {C.ARC} / dist))"


@query(
    "G34_offset_polygon",
    f"""WITH {TILTED_SQL}, s AS (SELECT page_id, line_id, p, list_transform([1, 2, 3, 4], lambda k: sqrt(pow(p[k % 4 + 1].x - p[k].x, 2) + pow(p[k % 4 + 1].y - p[k].y, 2))) AS sides,
  abs(list_sum(list_transform([1, 2, 3, 4], lambda k: p[k].x * p[k % 4 + 1].y - p[k % 4 + 1].x * p[k].y))) / 2 AS area FROM shaped),
d AS (SELECT *, area * 2.2::DOUBLE / list_sum(sides) AS dist FROM s WHERE area > 0),
a AS (SELECT *, {_STEP} AS step, list_transform([1, 2, 3, 4], lambda k: atan2(-(p[k % 4 + 1].x - p[k].x), p[k % 4 + 1].y - p[k].y)) AS outs FROM d),
c AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM a),
t AS (SELECT page_id, line_id, dist, step, k, p[k].x AS px, p[k].y AS py, outs[(k + 2) % 4 + 1] AS start, outs[k] - outs[(k + 2) % 4 + 1] - 2 * pi() * floor((outs[k] - outs[(k + 2) % 4 + 1]) / (2 * pi())) AS sweep FROM c),
n AS (SELECT *, CAST(greatest(1, ceil(sweep / step)) AS BIGINT) AS n FROM t),
q AS (SELECT page_id, line_id, dist, k, j, px + dist * cos(start + sweep * j / n) AS x, py + dist * sin(start + sweep * j / n) AS y FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM n)),
r AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM q WINDOW w AS (PARTITION BY page_id, line_id ORDER BY k, j))
SELECT page_id, line_id, round(any_value(dist), 6) AS distance, count(*) AS points, round(abs(sum(x * coalesce(y2, y0) - coalesce(x2, x0) * y)) / 2, 4) AS area FROM r GROUP BY page_id, line_id""",
)
def offset_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tilted line's quad moved outwards by 2.2 times its area over its perimeter, corners rounded: points and area."""

    def figures(batch: pa.RecordBatch) -> list[np.ndarray]:
        p = Q.rings(batch, "p")
        edge = np.roll(p, -1, axis=1) - p
        area, around = Q.area(p), np.sqrt((edge * edge).sum(axis=2)).sum(axis=1)
        some = area > 0
        points, wide, by = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p))
        by[some] = area[some] * 2.2 / around[some]
        points[some], wide[some] = Q.widened(p[some], by[some], C.ARC)
        return [by, points, wide]

    df = Q.with_figures(tilted(spark, sf_dir).select("page_id", "line_id", "p"), "by double, points bigint, wide double", figures, drop=("p",)).where("points > 0")
    return df.select("page_id", "line_id", F.round("by", 6).alias("distance"), "points", F.round("wide", 4).alias("area"))


def _cut_sql(ring: str, by: str, k: int) -> str:
    """``ring`` cut along edge k of ``by``, whose points go round as those of the tilted lines do."""
    a, b = f"{by}[{k}]", f"{by}[{k % 4 + 1}]"
    side = lambda p: f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"
    p, q = f"{ring}[i]", f"{ring}[i % len({ring}) + 1]"
    at = f"{side(p)} / ({side(p)} - {side(q)})"
    return f"""flatten(list_transform(range(1, len({ring}) + 1), lambda i: list_concat(CASE WHEN {side(p)} >= 0 THEN [{p}] ELSE [] END,
  CASE WHEN {side(p)} * {side(q)} < 0 THEN [{{'x': {p}.x + {at} * ({q}.x - {p}.x), 'y': {p}.y + {at} * ({q}.y - {p}.y)}}] ELSE [] END)))"""


def area_sql(ring: str) -> str:
    return f"CASE WHEN len({ring}) < 3 THEN 0 ELSE abs(list_sum(list_transform(range(1, len({ring}) + 1), lambda i: {ring}[i].x * {ring}[i % len({ring}) + 1].y - {ring}[i % len({ring}) + 1].x * {ring}[i].y))) / 2 END"


#: c1 to c4: the rings a of ``pairs`` cut along the edges of b, one after another.
CLIP_SQL = ", ".join(f"c{k} AS (SELECT * EXCLUDE (r), {_cut_sql('r', 'b', k)} AS r FROM {f'c{k - 1}' if k > 1 else 'pairs'})" for k in (1, 2, 3, 4))


@query(
    "G9_tilted_area",
    f"""WITH {TILTED_SQL}, pairs AS (SELECT a.page_id, a.line_id, a.p AS a, b.p AS b, a.p AS r FROM quads a JOIN quads b ON a.page_id = b.page_id AND b.line_id = a.line_id + 1), {CLIP_SQL}
SELECT page_id, line_id, round({area_sql("r")}, 5) AS area FROM c4""",
)
def tilted_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that each tilted line shares with the next one of its page."""
    shared = Q.with_figures(followed(tilted(spark, sf_dir)), "area double", lambda b: [Q.shared_areas(Q.rings(b, "p"), Q.rings(b, "q"))], drop=("p", "q"))
    return shared.select("page_id", "line_id", F.round("area", 5).alias("area"))


@query(
    "G12_hull",
    f"""WITH {TILTED_SQL}, points AS (SELECT DISTINCT page_id, v.x AS x, v.y AS y FROM (SELECT page_id, unnest(p) AS v FROM quads)),
edges AS (SELECT a.page_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM points a JOIN points b ON a.page_id = b.page_id AND (a.x <> b.x OR a.y <> b.y)),
t AS (SELECT e.*, (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) AS turn, (c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - by_) AS beyond FROM edges e JOIN points c ON c.page_id = e.page_id),
h AS (SELECT page_id, ax, ay, bx, by_ FROM t GROUP BY page_id, ax, ay, bx, by_ HAVING min(turn) >= 0 AND max(CASE WHEN turn = 0 THEN beyond ELSE 0 END) <= 0)
SELECT page_id, count(*) AS corners, round(abs(sum(ax * by_ - bx * ay)) / 2, 5) AS area, round(sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))), 5) AS around FROM h GROUP BY page_id""",
)
def region_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull of all corners of a page's tilted lines. Lines of a page that meet in a batch leave their own hull, so a page of any size meets as a few corners."""

    def figures(batch: pa.RecordBatch) -> list[list]:
        found = []
        for points in _rings_of(batch.column("p")):
            ring = C.hull(points)
            edge = np.roll(ring, -1, axis=0) - ring
            found.append((len(ring), C.area_of(ring) if len(ring) > 2 else 0.0, float(np.sqrt((edge * edge).sum(axis=1)).sum())))
        return list(zip(*found)) or [[], [], []]

    parts = tilted(spark, sf_dir).select("page_id", "p").mapInArrow(_parts_of_pages, "page_id bigint, p array<struct<x:double,y:double>>")
    whole = parts.groupBy("page_id").agg(F.flatten(F.collect_list("p")).alias("p"))
    whole = Q.with_figures(whole, "corners bigint, area double, around double", figures, drop=("p",))
    return whole.select("page_id", "corners", F.round("area", 5).alias("area"), F.round("around", 5).alias("around"))


def _rings_of(lists: pa.ListArray) -> list[np.ndarray]:
    flat = lists.flatten()
    points = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
    return np.split(points, np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _parts_of_pages(batches: Iterator[pa.RecordBatch], most: int = 16) -> Iterator[pa.RecordBatch]:
    """Corners by page: those of lines that follow each other are one row, as their hull where they are more than ``most``."""
    for batch in batches:
        page = Q.column(batch, "page_id")
        starts = np.flatnonzero(np.diff(page, prepend=page[:1] - 1))
        groups = np.split(Q.rings(batch, "p").reshape(-1, 2), 4 * starts[1:])
        groups = [C.hull(g) if len(g) > most else g for g in groups]
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
        points = np.concatenate(groups)
        flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
        yield pa.RecordBatch.from_arrays([pa.array(page[starts]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["page_id", "p"])


_SQUARE_SQL = "[{'x': p[1].x - 4, 'y': p[1].y - 4}, {'x': p[1].x - 4 + cw, 'y': p[1].y - 4}, {'x': p[1].x - 4 + cw, 'y': p[1].y - 4 + ch}, {'x': p[1].x - 4, 'y': p[1].y - 4 + ch}]"
#: Components at each tilted line's first corner, beside all lines of the page: shared area of both, and the line's distance from the component's middle.
MATCH_SQL = f"""{TILTED_SQL}, sized AS (SELECT page_id, line_id AS component, p, 2.0::DOUBLE + (line_id * 5) % 23 AS cw, 2.0::DOUBLE + (line_id * 3) % 19 AS ch FROM quads),
parts AS (SELECT page_id, component, cw, ch, {_SQUARE_SQL} AS square, {{'x': p[1].x - 4 + cw / 2, 'y': p[1].y - 4 + ch / 2}} AS middle FROM sized WHERE cw * ch > 9),
pairs AS (SELECT a.page_id, a.component, a.cw, a.ch, b.line_id, b.font, a.square AS b, b.p AS r, b.p AS q, [a.middle, a.middle, a.middle, a.middle] AS dot, b.ring AS ring FROM parts a JOIN shaped b ON a.page_id = b.page_id), {CLIP_SQL},
sized2 AS (SELECT *, {area_sql("q")} AS line_area, {area_sql("r")} AS common, list_transform([1, 2, 3, 4], lambda k: (ring[k].b.x - ring[k].a.x) * (dot[1].y - ring[k].a.y) - (ring[k].b.y - ring[k].a.y) * (dot[1].x - ring[k].a.x)) AS sides FROM c4),
scored AS (SELECT *, common / least(cw * ch, line_area) AS share, CASE WHEN list_min(sides) >= 0 OR list_max(sides) <= 0 THEN 0 ELSE sqrt(list_min(list_transform(ring, lambda e: pow(dot[1].x - e.a.x - greatest(0, least(1, ((dot[1].x - e.a.x) * (e.b.x - e.a.x) + (dot[1].y - e.a.y) * (e.b.y - e.a.y)) / greatest(pow(e.b.x - e.a.x, 2) + pow(e.b.y - e.a.y, 2), 1e-12))) * (e.b.x - e.a.x), 2)
  + pow(dot[1].y - e.a.y - greatest(0, least(1, ((dot[1].x - e.a.x) * (e.b.x - e.a.x) + (dot[1].y - e.a.y) * (e.b.y - e.a.y)) / greatest(pow(e.b.x - e.a.x, 2) + pow(e.b.y - e.a.y, 2), 1e-12))) * (e.b.y - e.a.y), 2)))) END AS far FROM sized2)"""


def tilted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, component, cw, ch and the lines that overlap it most (``most``) and lie nearest (``nearest``)."""
    quads = tilted(spark, sf_dir)
    k, corner = F.col("line_id"), F.get("p", F.lit(0))
    parts = quads.select("page_id", k.alias("component"), (corner["x"] - 4).alias("cx"), (corner["y"] - 4).alias("cy"), (2.0 + k * 5 % 23).alias("cw"), (2.0 + k * 3 % 19).alias("ch")).where("cw * ch > 9")
    both = parts.join(quads.select("page_id", "line_id", "p", "font"), "page_id")
    best = both.mapInArrow(best_lines, "page_id bigint, component bigint, cw double, ch double, most struct<less:double,line_id:bigint,share:double,line_area:double>, nearest struct<far:double,line_id:bigint,font:double>")
    return best.groupBy("page_id", "component", "cw", "ch").agg(F.min("most").alias("most"), F.min("nearest").alias("nearest"))


def best_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of components beside lines, each component's best lines in the batch: by overlap, and by the distance of its middle."""
    for whole in batches:
        for start in range(0, whole.num_rows, Q.ROWS):
            batch = whole.slice(start, Q.ROWS)
            page, component, line, cx, cy, w, h, font = (Q.column(batch, c) for c in ("page_id", "component", "line_id", "cx", "cy", "cw", "ch", "font"))
            p = Q.rings(batch, "p")
            square = np.stack([np.stack([cx + dx * w, cy + dy * h], axis=1) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))], axis=1)
            area = Q.area(p)
            share = Q.shared_areas(p, square) / np.minimum(w * h, area)
            less, far = -share.round(9) + 0.0, Q.point_gaps(np.stack([cx + w / 2, cy + h / 2], axis=1), p).round(9)
            first = {}
            for name, key in (("most", less), ("nearest", far)):
                order = np.lexsort((line, key, component, page))
                begins = (np.diff(page[order], prepend=page[order[0]] - 1) != 0) | (np.diff(component[order], prepend=component[order[0]] - 1) != 0)
                first[name] = order[begins]
            m, n = first["most"], first["nearest"]
            most = pa.StructArray.from_arrays([less[m], line[m], share[m], area[m]], names=["less", "line_id", "share", "line_area"])
            nearest = pa.StructArray.from_arrays([far[n], line[n], font[n]], names=["far", "line_id", "font"])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[m]) for c in (page, component, w, h)), most, nearest], names=["page_id", "component", "cw", "ch", "most", "nearest"])


@query(
    "J3_tilted_match",
    f"""WITH {MATCH_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY page_id, component ORDER BY round(share, 9) DESC, line_id) AS nth, first_value(line_id) OVER (PARTITION BY page_id, component ORDER BY round(far, 9), line_id) AS nearest FROM scored)
SELECT page_id, component, CASE WHEN round(share, 9) > 0 THEN line_id ELSE nearest END AS line_id, round(share, 6) AS share FROM m WHERE nth = 1""",
)
def tilted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's line: the one that it overlaps most, else the nearest."""
    line = F.when(F.col("most.less") < 0, F.col("most.line_id")).otherwise(F.col("nearest.line_id"))
    return tilted_matches(spark, sf_dir).select("page_id", "component", line.alias("line_id"), F.round("most.share", 6).alias("share"))


@query(
    "P11_tilted_kept",
    f"""WITH {MATCH_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY page_id, component ORDER BY round(share, 9) DESC, line_id) AS nth FROM scored), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, component ORDER BY round(far, 9), line_id) AS nth FROM scored)
SELECT m.page_id, m.component, CASE WHEN round(m.share, 9) > 0.01 THEN m.line_id ELSE n.line_id END AS line_id FROM m JOIN n ON n.page_id = m.page_id AND n.component = m.component AND n.nth = 1
WHERE m.nth = 1 AND m.cw * m.ch < m.line_area AND (round(m.share, 9) > 0.01 OR round(n.far, 9) < 0.5 * greatest(least(n.font, n.cw, n.ch), 10))""",
)
def tilted_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that are smaller than the tilted line they overlap most: it takes them, or with hardly any overlap the nearest if it is near enough."""
    best = tilted_matches(spark, sf_dir)
    overlaps = F.col("most.less") < -0.01
    near = F.col("nearest.far") < 0.5 * F.greatest(F.least("nearest.font", "cw", "ch"), F.lit(10))
    kept = best.where((F.col("cw") * F.col("ch") < F.col("most.line_area")) & (overlaps | near))
    return kept.select("page_id", "component", F.when(overlaps, F.col("most.line_id")).otherwise(F.col("nearest.line_id")).alias("line_id"))
