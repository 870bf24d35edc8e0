"""Geometry of axis-aligned boxes, colours and layout figures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Fixed values of sRGB with the D65 white: rows of X, Y, Z; white's X and Z; the weight of lightness in a colour difference.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE, LIGHTNESS = (0.950456, 1.088754), 0.392


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def font_size(w: Column, h: Column) -> Column:
    return F.least(w, h)


def box_gap(a: str, b: str) -> Column:
    """Distance of two boxes with columns prefixed a and b: 0 where they touch."""
    ax, ay, aw, ah = cols(*(f"{a}_{c}" for c in "xywh"))
    bx, by, bw, bh = cols(*(f"{b}_{c}" for c in "xywh"))
    dx = F.greatest(bx - (ax + aw), ax - (bx + bw), F.lit(0))
    dy = F.greatest(by - (ay + ah), ay - (by + bh), F.lit(0))
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def overlap_area(a: str, b: str) -> Column:
    ax, ay, aw, ah = cols(*(f"{a}_{c}" for c in "xywh"))
    bx, by, bw, bh = cols(*(f"{b}_{c}" for c in "xywh"))
    across = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
    down = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))
    return across * down


def iou(a: str, b: str) -> Column:
    both = overlap_area(a, b)
    union = F.col(f"{a}_w") * F.col(f"{a}_h") + F.col(f"{b}_w") * F.col(f"{b}_h") - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def can_merge(a: str, b: str, aspect: float, fonts: float, gap: float, gap2: float, ratio: float = 1.9, far: float = 2.0) -> Column:
    """Whether two axis-aligned lines belong to one region.

    Too far apart, too unlike in font or opposed in shape: no. Near: centres in
    one column yes; shapes at odds no; wide lines need an edge of left or right in
    common, tall ones of top or bottom.
    """
    (ax, ay, aw, ah), (bx, by, bw, bh) = (cols(*(f"{p}_{c}" for c in "xywh")) for p in (a, b))
    fa, fb = font_size(aw, ah), font_size(bw, bh)
    size, d = F.least(fa, fb), box_gap(a, b)
    shape_a, shape_b = aw / ah, bw / bh
    opposed = ((shape_a > aspect) & (shape_b < 1 / aspect)) | ((shape_b > aspect) & (shape_a < 1 / aspect))
    centred = F.abs(ax + F.floor(aw / 2) - (bx + F.floor(bw / 2))) < gap2
    wide_a, wide_b, tall_a, tall_b = aw > ah * ratio, bw > bh * ratio, ah > aw * ratio, bh > bw * ratio
    near = lambda p, q: F.abs(p - q) < size * gap2
    sides = near(ax, bx) | near(ax + aw, bx + bw)
    ends = near(ay, by) | near(ay + ah, by + bh)
    shaped = F.when((wide_a & tall_b) | (wide_b & tall_a), False).when(wide_a | wide_b, sides).when(tall_a | tall_b, ends).otherwise(False)
    ok = (d <= far * size) & (F.greatest(fa, fb) / size <= fonts) & ~opposed & (d < size * gap)
    return ok & F.when(centred, True).otherwise(shaped)


def truncated_mean(a: Column, b: Column) -> Column:
    return ((a + b) / 2).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bubble_confidence(flood: Column, area: Column, compact: Column, bw: Column, bh: Column, tw: Column, th: Column) -> Column:
    """How sure a bubble is, from its area over the text's, its compactness and how it fits the text."""
    one = F.lit(1)
    area_term = clamp((flood / F.greatest(area, one) - 1.0) / 4.0, 0.0, 1.0)
    fit = 0.5 * clamp(bw / F.greatest(tw, one), 0.0, 1.0) + 0.5 * clamp(bh / F.greatest(th, one), 0.0, 1.0)
    return 0.45 * area_term + 0.30 * clamp(compact, 0.0, 1.0) + 0.25 * fit


def adaptive_padding(flood: Column, tw: Column, th: Column, chars: Column, base: Column) -> Column:
    """Pixels of erosion: grows with the bubble, shrinks with the text's density, 3 to 24 and 22 % of the smaller side at most."""
    dim = F.greatest(F.lit(1.0), F.sqrt(F.greatest(flood, F.lit(1)).cast("double")))
    density = clamp(1.06 - 0.16 * (chars / dim), 0.72, 1.12)
    mixed = (0.45 * base + 0.55 * (0.06 * dim)) * density
    top = F.greatest(F.lit(3), (F.least(tw, th) * 0.22).cast("long"))
    return F.greatest(F.lit(3), F.least(F.lit(24), top, F.bround(mixed).cast("long")))


# The coefficients and steps of the four figures around here are fixed values.
def fallback_cap(confidence: Column, severity: Column) -> Column:
    """Largest enlargement, by steps of the bubble's confidence, a tenth more in severe cases."""
    c = F.coalesce(confidence, F.lit(0.0))
    cap = F.when(c < 0.25, 2.5).when(c < 0.45, 2.2).when(c < 0.65, 1.9).when(c < 0.80, 1.7).otherwise(1.5)
    return F.when(severity > 2.0, F.least(F.lit(2.5), cap + 0.1)).otherwise(cap)


def early_bias(confidence: Column, ratio: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when((c < 0.20) & (ratio > 1.2), 1.2).when((c < 0.30) & (ratio > 1.6), 1.1).otherwise(1.0)


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """8-bit CIE L*a*b* of an 8-bit sRGB colour: L over 0 to 255, a and b moved by 128."""
    linear = [F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    x, y, z = (sum((k * c for k, c in zip(row, linear)), F.lit(0.0)) for row in XYZ)
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    fx, fy, fz = f(x / WHITE[0]), f(y), f(z / WHITE[1])
    lightness = F.when(y > 0.008856, 116 * fy - 16).otherwise(903.3 * y)
    return [clamp(F.round(v, 0), 0, 255) for v in (lightness * 255 / 100, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128)]


def color_difference(one: list[Column], two: list[Column]) -> Column:
    """Distance of two sRGB colours in 8-bit L*a*b*, the lightness weighed by :data:`LIGHTNESS`."""
    d = [p - q for p, q in zip(lab(*one), lab(*two))]
    return F.sqrt(F.pow(LIGHTNESS * d[0], F.lit(2.0)) + d[1] * d[1] + d[2] * d[2])


def ordered_corners(points: Column) -> tuple[Column, Column]:
    """(is vertical, corners from the top left clockwise) of four points (x, y) in any order.

    The third and fourth shortest of the six distances are the long sides; their
    mean direction says whether the quad stands. Ties go by the other coordinate.
    """
    p = lambda k: points[k]
    pairs = F.array(*[
        F.struct(((p(i)["x"] - p(j)["x"]) * (p(i)["x"] - p(j)["x"]) + (p(i)["y"] - p(j)["y"]) * (p(i)["y"] - p(j)["y"])).alias("far"), (p(i)["x"] - p(j)["x"]).alias("dx"), (p(i)["y"] - p(j)["y"]).alias("dy"))
        for i in range(4) for j in range(i + 1, 4)
    ])
    sides = F.array_sort(pairs)
    a, b = sides[2], sides[3]
    turn = F.when(a["dx"] * b["dx"] + a["dy"] * b["dy"] < 0, -1).otherwise(1)
    vertical = F.abs(a["dx"] * turn + b["dx"]) <= F.abs(a["dy"] * turn + b["dy"])
    swap = lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x"))
    down = F.array_sort(F.transform(points, swap))  # by y, then x
    across = F.array_sort(F.transform(points, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    first = lambda q, r, c: F.when(q[c] <= r[c], q).otherwise(r)
    last = lambda q, r, c: F.when(q[c] <= r[c], r).otherwise(q)
    standing = [first(down[0], down[1], "x"), last(down[0], down[1], "x"), last(down[2], down[3], "x"), first(down[2], down[3], "x")]
    lying = [first(across[0], across[1], "y"), first(across[2], across[3], "y"), last(across[2], across[3], "y"), last(across[0], across[1], "y")]
    both = [F.when(vertical, F.struct(s["x"].alias("x"), s["y"].alias("y"))).otherwise(q) for s, q in zip(standing, lying)]
    return vertical, F.array(*both)


def sound_quad(points: list[tuple[Column, Column]], base: list[tuple[Column, Column]], angle: Column) -> list[tuple[Column, Column]]:
    """A quad to draw in: the base one where the given one is under 20 pixels, not convex or has an edge under 4.

    A level quad of a region at 10 to 45 degrees is turned by 0.35 of that angle, 10 degrees at most.
    """
    ring = list(zip(points, points[1:] + points[:1]))
    area = F.abs(sum((a[0] * b[1] - b[0] * a[1] for a, b in ring), F.lit(0))) / 2
    turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for (a, b), (_, c) in zip(ring, ring[1:] + ring[:1])]
    convex = (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)
    shortest = F.least(*[(b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]) for a, b in ring])
    poor = (area < 20) | ~convex | (shortest < 16)
    held = [tuple(F.when(poor, q).otherwise(p).cast("double") for p, q in zip(*both)) for both in zip(points, base)]
    level = F.abs(F.degrees(F.atan2(held[1][1] - held[0][1], held[1][0] - held[0][0]))) < 3
    leans = (F.abs(angle) > 10) & (F.abs(angle) < 45) & level
    by = F.radians(F.when(leans, clamp(angle * 0.35, -10.0, 10.0)).otherwise(0.0))
    cx, cy = (sum((p[k] for p in held), F.lit(0.0)) / 4 for k in (0, 1))
    return [(cx + (x - cx) * F.cos(by) - (y - cy) * F.sin(by), cy + (x - cx) * F.sin(by) + (y - cy) * F.cos(by)) for x, y in held]


def turned(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    """A point turned about a centre, by an angle from the vertical."""
    return (y - cy) * F.sin(angle) + (x - cx) * F.cos(angle) + cx, (y - cy) * F.cos(angle) - (x - cx) * F.sin(angle) + cy


def rect_distance(ax: Column, ay: Column, ax2: Column, ay2: Column, bx: Column, by: Column, bx2: Column, by2: Column) -> Column:
    """Distance of two rectangles given by their corners: between corners, along an axis where they face each other, 0 where they meet."""
    across, down = F.greatest(ax - bx2, bx - ax2), F.greatest(ay - by2, by - ay2)
    return F.when((across > 0) & (down > 0), F.sqrt((across * across + down * down).cast("double"))).otherwise(F.greatest(across, down, F.lit(0)).cast("double"))


def quad_gap(p: Column, q: Column) -> Column:
    """Distance of two convex quads, arrays of four points (x, y) in ring order: 0 where they meet or one holds the other."""
    ring = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.get(c, k).alias("a"), F.get(c, (k + 1) % 4).alias("b")))

    def apart(e: Column) -> Column:
        nx, ny = e["a"]["y"] - e["b"]["y"], e["b"]["x"] - e["a"]["x"]
        one, two = (F.transform(c, lambda v: v["x"] * nx + v["y"] * ny) for c in (p, q))
        return (F.array_max(one) < F.array_min(two)) | (F.array_max(two) < F.array_min(one))

    def square(v: Column, e: Column) -> Column:
        ax, ay, dx, dy = e["a"]["x"], e["a"]["y"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        along = clamp(((v["x"] - ax) * dx + (v["y"] - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12)), 0.0, 1.0)
        ox, oy = v["x"] - ax - along * dx, v["y"] - ay - along * dy
        return ox * ox + oy * oy

    least = lambda c, d: F.array_min(F.flatten(F.transform(c, lambda v: F.transform(ring(d), lambda e: square(v, e)))))
    return F.when(F.exists(F.concat(ring(p), ring(q)), apart), F.sqrt(F.least(least(p, q), least(q, p)))).otherwise(0.0)


def quad_shape(p: Column) -> dict[str, Column]:
    """font, aspect, angle and the upright bounds x, y, w, h of a quad in ring order from the top left; middles of edges are cut to whole pixels."""
    middle = lambda i, j, c: truncated_mean(p[i][c], p[j][c]).cast("double")
    down = [middle(2, 3, c) - middle(0, 1, c) for c in "xy"]
    across = [middle(3, 0, c) - middle(1, 2, c) for c in "xy"]
    tall, wide = (F.sqrt(v[0] * v[0] + v[1] * v[1]) for v in (down, across))
    (x, x2), (y, y2) = ([of(*(p[k][c] for k in range(4))) for of in (F.least, F.greatest)] for c in "xy")
    return {
        "font": F.least(tall, wide), "aspect": wide / tall, "angle": F.atan2(down[0], down[1]),
        "x": x, "y": y, "w": x2 - x, "h": y2 - y,
    }


def can_merge_quads(a: str, b: str, aspect: float, fonts: float, gap: float, gap2: float, ratio: float = 1.9, far: float = 2.0) -> Column:
    """:func:`can_merge` for quads with columns of :func:`quad_shape` under the prefixes, and their distance in ``gap``.

    Two that are upright to 15 degrees go by their bounds; others need nearly the
    same angle, fonts within a quarter and a small distance.
    """
    (ax, ay, aw, ah, fa, sa, ta), (bx, by, bw, bh, fb, sb, tb) = (cols(*(f"{k}_{c}" for c in ("x", "y", "w", "h", "font", "aspect", "angle"))) for k in (a, b))
    size, d = F.least(fa, fb), F.col("gap")
    straight = (F.abs(ta) < 15 * F.pi() / 180) & (F.abs(tb) < 15 * F.pi() / 180)
    opposed = ((sa > aspect) & (sb < 1 / aspect)) | ((sb > aspect) & (sa < 1 / aspect))
    centred = F.abs(ax + F.floor(aw / 2) - (bx + F.floor(bw / 2))) < gap2
    wide_a, wide_b, tall_a, tall_b = aw > ah * ratio, bw > bh * ratio, ah > aw * ratio, bh > bw * ratio
    near = lambda u, v: F.abs(u - v) < size * gap2
    shaped = F.when((wide_a & tall_b) | (wide_b & tall_a), False).when(wide_a | wide_b, near(ax, bx) | near(ax + aw, bx + bw)).when(tall_a | tall_b, near(ay, by) | near(ay + ah, by + bh)).otherwise(False)
    level = (d < size * gap) & F.when(centred, True).otherwise(shaped)
    leant = (F.abs(ta - tb) < 15 * F.pi() / 180) & (d <= size * gap2) & (F.abs(fa - fb) / size <= 0.25)
    return (d <= far * size) & (F.greatest(fa, fb) / size <= fonts) & ~opposed & F.when(straight, level).otherwise(leant)


def inner_margin(side: Column, chars: Column) -> Column:
    """Margin inside a box, by its smaller side and the text's length."""
    whole = lambda c: F.bround(c).cast("long")
    wide = whole((0.040 * side + 1.0) * clamp(1.02 - 0.0022 * chars, 0.86, 1.08))
    return F.when(side < 70, F.greatest(F.lit(1), whole(side * 0.02))).when(side < 120, F.greatest(F.lit(2), whole(side * 0.03))).otherwise(F.greatest(F.lit(2), F.least(F.lit(10), wide)))
