"""From raw trait and image tables to annotation documents: keys, checks, nested measurements in the crop's coordinates.

traits (groupImageFilePath, BeetlePosition, and a JSON text of polylines in each column of TRAITS); images
(groupImageFilePath, individualImageFilePath, ..). A specimen's key is (group_img_basename, beetle_position).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions.arrays import rebased
from caliper.functions.strings import extract_int, strip_prefix, strip_suffix

KEYS = ("group_img_basename", "beetle_position")
# The trait columns and the measurement types that they hold.
TRAITS = {
    "coords_scalebar": "scalebar",
    "coords_elytra_max_length": "elytra_max_length",
    "coords_basal_pronotum_width": "basal_pronotum_width",
    "coords_elytra_max_width": "elytra_max_width",
}


def group_basename(path: Column) -> Column:
    return strip_suffix(strip_prefix(F.lower(path), "group_images/"), ".png")


def keyed_traits(traits: DataFrame) -> DataFrame:
    """traits with the key columns and their polylines as arrays; text that is no JSON list of lists is NULL."""
    polylines = {c: F.from_json(F.col(c), "array<array<double>>") for c in TRAITS if c in traits.columns}
    return traits.withColumns({KEYS[0]: group_basename(F.col("groupImageFilePath")), KEYS[1]: F.col("BeetlePosition").cast("bigint"), **polylines})


def keyed_images(images: DataFrame) -> DataFrame:
    """images with the key columns; the position stands in the file name, NULL if it does not."""
    return images.withColumns({KEYS[0]: group_basename(F.col("groupImageFilePath")), KEYS[1]: extract_int(F.lower("individualImageFilePath"), r"specimen_(\d+)")})


def key_problems(traits: DataFrame, images: DataFrame) -> DataFrame:
    """(problem, group_img_basename, beetle_position, n) of keyed tables: keys that stand more than once in a table, and keys of
    one table that the other lacks; a NULL key counts as lacking."""
    side = lambda df, t, i: df.select(*KEYS, F.lit(t).alias("t"), F.lit(i).alias("i"))
    rows = side(traits, 1, 0).unionByName(side(images, 0, 1)).groupBy(*KEYS).agg(F.sum("t").alias("t"), F.sum("i").alias("i"))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in KEYS])
    one = F.lit(1).cast("bigint")
    found = {
        "trait_duplicates": F.when(F.col("t") > 1, F.col("t")),
        "image_duplicates": F.when(F.col("i") > 1, F.col("i")),
        "images_without_traits": F.when((F.col("i") > 0) & (no_key | (F.col("t") == 0)), one),
        "traits_without_images": F.when((F.col("t") > 0) & (no_key | (F.col("i") == 0)), one),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), n.alias("n")) for k, n in found.items()]))
    return rows.select(*KEYS, each.alias("p")).where("p.n is not null").select("p.problem", *KEYS, "p.n")


def measurements(origin_x: Column, origin_y: Column) -> Column:
    """array<struct<measurement_type, polyline_px>> of a row of keyed traits: every polyline with the crop's origin taken off,
    trait by trait; those of odd length or below two numbers are left out, as are NULL lists."""

    def of(column: str, kind: str) -> Column:
        moved = F.transform(F.coalesce(F.col(column), F.array().cast("array<array<double>>")), lambda p: rebased(p, origin_x, origin_y))
        return F.transform(F.filter(moved, lambda p: p.isNotNull()), lambda p: F.struct(F.lit(kind).alias("measurement_type"), p.alias("polyline_px")))

    return F.concat(*[of(c, kind) for c, kind in TRAITS.items()])


def annotation_documents(traits: DataFrame, images: DataFrame, origins: DataFrame) -> DataFrame:
    """images (keyed) with origin_x, origin_y and `measurements`, a document for each image that has traits and an origin.

    origins (keys, origin_x, origin_y): where the specimen's crop lies in its group image. Of rows that repeat a key in traits
    or origins one counts; images are kept each."""
    least = lambda df, *cols: df.groupBy(*KEYS).agg(F.min(F.struct(*cols)).alias("__least")).select(*KEYS, "__least.*")
    joined = images.join(least(origins, "origin_x", "origin_y"), list(KEYS)).join(least(traits.select(*KEYS, *TRAITS).repartition(*KEYS), *TRAITS), list(KEYS))
    return joined.withColumn("measurements", measurements(F.col("origin_x"), F.col("origin_y"))).select(*images.columns, "origin_x", "origin_y", "measurements")
