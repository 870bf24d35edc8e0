"""Reading order of a page's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Pixels of a gap that starts a new column, and a new row.
COLUMN_GAP, ROW_GAP = 20, 15


def coordinate_order(boxes: DataFrame, right_to_left: bool = True) -> DataFrame:
    """Add place (from 1): along the axis of the larger spread, in groups that gaps part, across inside a group.

    Where the spreads are equal but for rounding, what rounding makes of them decides, in the order of the lines
    and by the steps of :func:`_squares`: so the order of a page is the same however its lines come in.
    """
    page = Window.partitionBy("page_id")
    df = boxes.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    df = df.withColumns({"_n": F.count("*").over(page), "_sx": F.stddev_pop("cx").over(page), "_sy": F.stddev_pop("cy").over(page)})
    level = (F.col("_n") > 1) & (F.abs(F.col("_sx") - F.col("_sy")) <= 1e-9 * F.greatest("_sx", "_sy"))
    df = df.withColumn("_own", F.array_sort(F.collect_list(F.when(level, F.struct("line_id", "cx", "cy"))).over(page)))  # empty for all other pages
    by_line = F.sqrt(_squares("_own", "cx") / F.col("_n")) > F.sqrt(_squares("_own", "cy") / F.col("_n"))
    larger = F.when(F.size("_own") > 0, by_line).otherwise(F.col("_sx") > F.col("_sy"))
    df = df.withColumn("across", (F.col("_n") > 1) & larger).drop("_n", "_sx", "_sy", "_own")
    side: Column = -F.col("cx") if right_to_left else F.col("cx")
    df = df.withColumns({"first": F.when(F.col("across"), side).otherwise(F.col("cy")), "second": F.when(F.col("across"), F.col("cy")).otherwise(side)})
    along = page.orderBy("first", "line_id")
    gap = F.col("first") - F.lag("first").over(along)
    df = df.withColumn("starts", (gap > F.when(F.col("across"), COLUMN_GAP).otherwise(ROW_GAP)).cast("int"))
    df = df.withColumn("block", F.sum(F.coalesce("starts", F.lit(0))).over(along))
    return df.withColumn("place", F.row_number().over(page.orderBy("block", "second", "first", "line_id")))


def _squares(points: str, c: str) -> Column:
    """Sum of the square distances of the points' ``c`` from its mean: each value moves the mean, and adds its distance from the old one times that from the new."""

    def step(a: Column, p: Column) -> Column:
        mean = a["mean"] + (p[c] - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["sum"] + (p[c] - mean) * (p[c] - a["mean"])).alias("sum"))

    return F.aggregate(points, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def insertion_order(boxes: DataFrame, right_to_left: bool = True) -> DataFrame:
    """(page_id, line_id, place): boxes by height, each put before the first placed box that is beside it on the far side, or below it.

    What is placed decides where the next goes, so a page is one array and its
    fold. Of boxes of one height the one with the smaller line_id comes first.
    """
    box = F.struct((F.col("y") + F.col("h") / 2).alias("cy"), "line_id", (F.col("x") + F.col("w") / 2).alias("cx"), F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"))
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def before(b: Column, p: Column) -> Column:
        beside = b["cx"] > p["cx"] if right_to_left else b["cx"] < p["cx"]
        return (b["cy"] <= p["bottom"]) & ((b["cy"] < p["top"]) | beside)

    def put(placed: Column, b: Column) -> Column:
        at = F.array_position(F.transform(placed, lambda p: before(b, p)), F.lit(True)).cast("int")
        return F.array_insert(placed, F.when(at > 0, at).otherwise(F.size(placed) + 1), b)

    order = F.aggregate("boxes", F.slice("boxes", 1, 0), put)
    placed = pages.select("page_id", F.posexplode(order).alias("at", "b"))
    return placed.select("page_id", F.col("b.line_id").alias("line_id"), (F.col("at") + 1).alias("place"))


def row_fill(panels: DataFrame, right_to_left: bool = True) -> DataFrame:
    """(page_id, line_id, place): rows of panels, each from its top-most one down to a tolerance, and across within a row.

    The tolerance is 10 pixels or 0.3 of the mean height. A row starts at its own
    first panel, not at the one before, so rows are a fold over the page's panels
    by height.
    """
    panel = F.struct("y", "line_id", "x")
    pages = panels.groupBy("page_id").agg(F.array_sort(F.collect_list(panel)).alias("panels"), F.greatest(F.lit(10.0), F.avg("h") * 0.3).alias("near"))
    start = F.struct(F.lit(None).cast("long").alias("base"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def put(a: Column, p: Column) -> Column:
        new = a["base"].isNull() | (p["y"] - a["base"] > F.col("near"))
        row = a["row"] + new.cast("int")
        return F.struct(F.when(new, p["y"]).otherwise(a["base"]).alias("base"), row.alias("row"), F.array_append(a["rows"], row).alias("rows"))

    rows = F.aggregate("panels", start, put, lambda a: a["rows"])
    each = pages.select("page_id", F.explode(F.arrays_zip("panels", rows.alias("row"))).alias("z")).select("page_id", "z.panels.line_id", "z.panels.x", "z.panels.y", "z.row")
    side = -F.col("x") if right_to_left else F.col("x")
    return each.select("page_id", "line_id", F.row_number().over(Window.partitionBy("page_id").orderBy("row", side, "y", "line_id")).alias("place"))
