"""Connected regions of images as runs of pixels.

An image is rows of pixels, one row of the table each, so that the rows of a large image are many tasks' work. What a mask keeps
of a row becomes runs, by gaps and islands; runs of neighbouring rows that touch are edges; regions are the components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.operators.components import connected_components

#: Pixels of a cell in which runs of neighbouring rows meet.
CELL = 64


def pixel_rows(images: DataFrame, image: str, pixels: str, width: int) -> DataFrame:
    """(image, y, pixels): the rows of images stored as one list, row after row; a last incomplete row is a shorter row."""
    at = F.sequence(F.lit(0), F.ceil(F.size(pixels) / width).cast("int") - 1)
    known = images.where(F.size(pixels) > 0)
    return known.select(image, F.explode(at).alias("y"), F.col(pixels).alias("__p")).select(image, "y", F.slice("__p", F.col("y") * width + 1, width).alias(pixels))


def mask_runs(rows: DataFrame, image: str, pixels: str, keep: Callable[[Column], Column]) -> DataFrame:
    """(image, y, x0, x1): the runs of pixels of each row that `keep` holds for, both ends included. A NULL pixel is not kept;
    (image, y) is unique."""
    kept = F.filter(F.sequence(F.lit(0), F.size(pixels) - 1), lambda x: F.coalesce(keep(F.get(pixels, x)), F.lit(False)))
    at = rows.where(F.size(pixels) > 0).select(image, F.col("y").cast("int").alias("y"), F.posexplode(kept).alias("__i", "x"))
    runs = at.groupBy(image, "y", (F.col("x") - F.col("__i")).alias("__island")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.drop("__island")


def red_run_keep(red_min: float, other_max: float) -> Callable[[Column], Column]:
    """A mask for pixels that are structs (r, g, b): red enough, and neither green nor blue."""
    return lambda p: (p["r"] > red_min) & (p["g"] < other_max) & (p["b"] < other_max)


def regions(runs: DataFrame, image: str) -> DataFrame:
    """(image, first_y, first_x, x, y, w, h, area) of the regions of runs (image, y, x0, x1) under 8-connectivity; (first_y,
    first_x) is a region's first pixel in reading order.

    Runs meet in the cells of their rows that they cover, widened by a pixel, and a pair in the one cell that holds the start of
    its overlap: a row with many runs costs its runs and contacts, not their square."""
    cells = F.explode(F.sequence(F.floor((F.col("x0") - 1) / CELL), F.floor((F.col("x1") + 1) / CELL)))
    placed = runs.where(F.col(image).isNotNull()).select(image, "y", "x0", "x1", cells.alias("__cell"))
    upper, lower = placed.alias("a"), placed.withColumn("y", F.col("y") - 1).alias("b")
    col = lambda side, c: F.col(f"{side}.{c}")
    same = (col("a", image) == col("b", image)) & (col("a", "y") == col("b", "y")) & (col("a", "__cell") == col("b", "__cell"))
    touch = (col("a", "x0") <= col("b", "x1") + 1) & (col("b", "x0") <= col("a", "x1") + 1)
    start = F.floor((F.greatest(col("a", "x0"), col("b", "x0")) - 1) / CELL) == col("a", "__cell")
    node = lambda side, y: F.struct(col(side, image).alias("image"), y.alias("y"), col(side, "x0").alias("x0"))
    pairs = upper.join(lower, same).where(touch & start).select(node("b", col("b", "y") + 1).alias("u"), node("a", col("a", "y")).alias("v"))
    found = connected_components(pairs).select(F.col("id.image").alias(image), F.col("id.y").alias("y"), F.col("id.x0").alias("x0"), F.col("component.y").alias("__y"), F.col("component.x0").alias("__x"))
    named = runs.where(F.col(image).isNotNull()).join(found, [image, "y", "x0"], "left")
    first = named.withColumns({"first_y": F.coalesce("__y", "y"), "first_x": F.coalesce("__x", "x0")})
    boxes = first.groupBy(image, "first_y", "first_x").agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("__x1"), F.max("y").alias("__y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    return boxes.select(image, "first_y", "first_x", "x", "y", (F.col("__x1") - F.col("x") + 1).alias("w"), (F.col("__y1") - F.col("y") + 1).alias("h"), "area")


def largest_region(runs: DataFrame, image: str, least_area: int) -> DataFrame:
    """(image, x, y, w, h, area): the largest region of each image, of several the first in reading order; images whose largest
    region has fewer than least_area pixels have no row."""
    of = regions(runs, image)
    best = F.min_by(F.struct("x", "y", "w", "h", "area"), F.struct(-F.col("area"), F.col("first_y"), F.col("first_x"))).alias("b")
    return of.groupBy(image).agg(best).select(image, "b.*").where(F.col("area") >= least_area)
