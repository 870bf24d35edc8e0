"""Convex polygons as arrays of points (x, y): hulls, clipping and offsets as array functions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_POINT = "struct<x:double,y:double>"


def settled(df: DataFrame) -> DataFrame:
    """Keeps the optimizer from working a column out anew inside each lambda that names it: a filter on a value that is not deterministic stays where it is."""
    return df.withColumn("_pin", F.monotonically_increasing_id()).where("_pin >= 0").drop("_pin")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def next_of(ring: Column) -> Column:
    """The ring with each point's follower in its place."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _turn(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def signed_area(ring: Column) -> Column:
    return F.aggregate(F.zip_with(ring, next_of(ring), _cross), F.lit(0.0), lambda s, c: s + c) / 2


def area(ring: Column) -> Column:
    """Of a ring in either direction; 0 for fewer than three points."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(signed_area(ring)))


def perimeter(ring: Column) -> Column:
    side = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return F.aggregate(F.zip_with(ring, next_of(ring), side), F.lit(0.0), lambda s, c: s + c)


def hull(points: Column) -> Column:
    """Corners of the convex hull of an array of points, without points on its edges.

    A monotone chain: in the order of x, each point drops the end of the chain from
    which it lies to the right. On a convex chain these are the last ones, so a filter
    over the chain finds them.
    """
    every = F.array_sort(F.array_distinct(points))

    def chain(order: Column) -> Column:
        def add(held: Column, p: Column) -> Column:
            stays = F.filter(held, lambda s, i: (i == 0) | (_turn(F.get(held, i - 1), s, p) > 0))
            return F.concat(stays, F.array(p))

        return F.aggregate(order, F.array().cast(f"array<{_POINT}>"), add)

    open_ = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    ring = F.concat(open_(chain(every)), open_(chain(F.reverse(every))))
    return F.when(F.size(every) < 3, every).otherwise(ring)


def clipped(ring: Column, by: Column) -> Column:
    """The part of a convex ring inside another: it is cut along each edge of ``by`` in turn."""
    edge = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    edges = F.when(signed_area(by) < 0, F.zip_with(next_of(by), by, edge)).otherwise(F.zip_with(by, next_of(by), edge))

    def cut(held: Column, e: Column) -> Column:
        side = lambda p: _turn(e["a"], e["b"], p)

        def part(p: Column, q: Column) -> Column:
            s, t = side(p), side(q)
            at = s / (s - t)
            meets = F.array(point(p["x"] + at * (q["x"] - p["x"]), p["y"] + at * (q["y"] - p["y"])))
            none = F.array().cast(f"array<{_POINT}>")
            return F.concat(F.when(s >= 0, F.array(point(p["x"], p["y"]))).otherwise(none), F.when(((s > 0) & (t < 0)) | ((s < 0) & (t > 0)), meets).otherwise(none))

        return F.flatten(F.zip_with(held, next_of(held), part))

    return F.aggregate(edges, F.transform(ring, lambda p: point(p["x"], p["y"])), cut)


def shared_area(ring: Column, other: Column) -> Column:
    """Area that two convex rings have in common."""
    return area(clipped(ring, other))


def point_gap(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point from a convex ring, 0 inside."""
    side = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])

    def square(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))))
        ox, oy = x - a["x"] - along * dx, y - a["y"] - along * dy
        return ox * ox + oy * oy

    sides = F.zip_with(ring, next_of(ring), side)
    return F.when((F.array_min(sides) >= 0) | (F.array_max(sides) <= 0), 0.0).otherwise(F.sqrt(F.array_min(F.zip_with(ring, next_of(ring), square))))


def widened(ring: Column, by: Column, arc: float) -> Column:
    """A convex ring, of growing angle as y points down, moved outwards by ``by``; corners become arcs within ``arc`` of the circle."""
    out = F.zip_with(ring, next_of(ring), lambda a, b: F.atan2(-(b["x"] - a["x"]), b["y"] - a["y"]))
    step = 2 * F.acos(F.greatest(F.lit(0.0), 1 - arc / by))

    def corner(p: Column, i: Column) -> Column:
        start = F.when(i == 0, F.element_at(out, -1)).otherwise(F.get(out, i - 1))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), start.alias("start"), (F.get(out, i) - start).alias("turn"))

    # each step has what it needs of a corner in a struct, so that nothing is worked out for each point of an arc
    swept = F.transform(F.transform(ring, corner), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["start"].alias("start"), (c["turn"] - 2 * F.pi() * F.floor(c["turn"] / (2 * F.pi()))).alias("sweep")))
    counted = F.transform(swept, lambda c: F.struct(c.alias("c"), F.greatest(F.lit(1), F.ceil(c["sweep"] / step).cast("int")).alias("n")))
    turned = lambda c, n, j: c["start"] + c["sweep"] * j / n
    arc_of = lambda d: F.transform(F.sequence(F.lit(0), d["n"]), lambda j: point(d["c"]["x"] + by * F.cos(turned(d["c"], d["n"], j)), d["c"]["y"] + by * F.sin(turned(d["c"], d["n"], j))))
    return F.flatten(F.transform(counted, arc_of))
