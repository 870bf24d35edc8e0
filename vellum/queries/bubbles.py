"""Bubbles, complete masks and crops over images with their regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.operators import bubbles as B
from vellum.operators.frames import Stack, over_frames, remainder, rounded
from vellum.operators.masks import drawn
from vellum.operators.regions import split_shared
from vellum.queries.registry import query
from vellum.sources.tables import read_table


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, regions (region_id, x, y, w, h, chars, q): two texts in the middle of an image and a third in its corner.

    q has the corners of the text's quad, at a small angle.
    """
    k, size = F.col("p_partkey"), F.col("p_size")
    df = read_table(spark, sf_dir, "part").select(k.alias("image_id"), (78 + size % 7).cast("int").alias("w"), (60 + k % 5).cast("int").alias("h"))
    i, w, h = F.col("image_id"), F.col("w"), F.col("h")

    def region(n: int, cx: Column, cy: Column, rw: Column, rh: Column) -> Column:
        x0, y0, lean = (cx - F.floor(rw / 2)).cast("int"), (cy - F.floor(rh / 2)).cast("int"), (i % 5 - 2).cast("int")
        corners = ((x0, y0), (x0 + rw, y0 + lean), (x0 + rw, y0 + rh + lean), (x0, y0 + rh))
        q = F.array(*[v.cast("int") for corner in corners for v in corner])
        return F.struct(F.lit(n).cast("long").alias("region_id"), x0.alias("x"), y0.alias("y"), rw.cast("int").alias("w"), rh.cast("int").alias("h"), (5 + i % 40).cast("int").alias("chars"), q.alias("q"))

    middle, low = (w / 2).cast("int"), (h / 2).cast("int")
    own = F.array(region(0, middle, low - 3, 20 + i % 6, 10 + i % 4), region(1, middle - 1, low + 4, 18 + i % 5, 8 + i % 3), region(2, F.lit(8), F.lit(8), 12 + i % 3, 7 + i % 2))
    return df.withColumn("regions", own)


def shade(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A light bubble on dark ground, with ink in some."""
    i, w, h = c["image_id"], c["w"], c["h"]
    dx, dy = (x - (w / 2 - 6 + i % 9)) / (16.0 + i % 5), (y - h / 2) / (15.0 + i % 6)
    light = np.where(i % 3 == 0, (np.abs(dx) < 1) & (np.abs(dy) < 1), dx * dx + dy * dy < 1)
    ink = (remainder(x, 2 * y + i, 9) < 2) & ((np.abs(x - w / 2) < 9) & (i % 4 == 1)) & (np.abs(y - h / 2) < 5)
    return remainder(x * 7, y * 13 + i, 17) + np.where(light & ~ink, np.int16(225), np.int16(60))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, grey, regions of :func:`regions_of`, drawn by :func:`shade`."""
    return drawn(regions_of(spark, sf_dir), shade).select("image_id", "w", "h", "grey", "regions")


def centre(r: dict) -> tuple[int, int]:
    return int(r["x"] + r["w"] / 2), int(r["y"] + r["h"] / 2)


def texts_of(regions: pa.StructArray, image: np.ndarray, horizontal: np.ndarray | None = None) -> B.Texts:
    """Of regions and their images' places; ``horizontal`` are those that are wider than high if it isn't given."""
    x, y, w, h, chars = (regions.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y", "w", "h", "chars"))
    return B.Texts(image, (x + w / 2).astype(np.int64), (y + h / 2).astype(np.int64), w, h, chars, w >= h if horizontal is None else horizontal)


def quads_of(regions: pa.StructArray) -> np.ndarray:
    return regions.field("q").flatten().to_numpy().reshape(-1, 4, 2)


@query("K4_single_bubble")
def single_bubble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each image's first text."""

    def each(s: Stack) -> list:
        image, regions = s.lists("regions")
        first = np.flatnonzero(np.diff(image, prepend=-1))
        image = image[first]
        found, box, score = B.bubbles(B.blurred(s.grey, s.w, s.h), s.w, s.h, texts_of(regions.take(pa.array(first)), image, np.ones(len(first), bool)))
        return [s.image_id[image[found]], *box.T, rounded(score)]

    return over_frames(regions_of(spark, sf_dir), "image_id bigint, x int, y int, w int, h int, confidence double", each, shade)


@query("K5_bubbles")
def all_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all texts of an image; texts that share a bubble share out its ground."""

    def each(s: Stack) -> list:
        image, regions = s.lists("regions")
        texts = texts_of(regions, image)
        found, box, score = B.bubbles(B.blurred(s.grey, s.w, s.h), s.w, s.h, texts)
        return [s.image_id[image[found]], regions.field("region_id").to_numpy()[found], texts.cx[found].astype(float), texts.cy[found].astype(float), *box.T, rounded(score)]

    found = over_frames(regions_of(spark, sf_dir), "page_id bigint, line_id bigint, cx double, cy double, x int, y int, w int, h int, confidence double", each, shade)
    return split_shared(found).select(F.col("page_id").alias("image_id"), F.col("line_id").alias("region_id"), "x", "y", "w", "h", "confidence")


@query("K7_complete_mask")
def complete_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, bounds and a checksum of each image's completed mask; the raw one has what is light."""

    def each(s: Stack) -> list:
        image, regions = s.lists("regions")
        y, x = (np.arange(n) for n in s.grey.shape[1:])
        spots = (s.grey > 200) & (np.add.outer(y * 3, x) % 11 > 2)
        fonts = np.minimum(*(regions.field(c).to_numpy() for c in "wh")).astype(float)
        masks, found = B.complete_masks(spots, s.w, s.h, image, quads_of(regions).astype(float), fonts)
        masks = masks[found]
        down, across = masks.sum(axis=2), masks.sum(axis=1)
        ends = lambda v: (np.argmax(v > 0, axis=1), v.shape[1] - 1 - np.argmax(v[:, ::-1] > 0, axis=1))
        (x0, x1), (y0, y1) = ends(across), ends(down)
        return [s.image_id[found], down.sum(axis=1), x0, y0, x1, y1, across @ (x * 31) + down @ (y * 17)]

    return over_frames(regions_of(spark, sf_dir), "image_id bigint, area bigint, x0 int, y0 int, x1 int, y1 int, checksum bigint", each, shade)


@query("K1_crops")
def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean and spread of the upright strip of each text."""

    def each(s: Stack) -> list:
        image, regions = s.lists("regions")
        across = regions.field("w").to_numpy() >= regions.field("h").to_numpy()
        size, mean, spread = np.zeros((2, len(image)), np.int64), np.zeros(len(image)), np.zeros(len(image))
        for k, strips in B.crops(s.grey, s.w, s.h, image, quads_of(regions), across):
            size[:, k] = np.array(strips.shape[:0:-1])[:, None]
            flat = strips.reshape(len(k), -1)
            mean[k], spread[k] = flat.mean(axis=1), flat.std(axis=1)
        return [s.image_id[image], regions.field("region_id"), *size, rounded(mean), rounded(spread)]

    return over_frames(regions_of(spark, sf_dir), "image_id bigint, region_id bigint, w int, h int, mean double, spread double", each, shade)
