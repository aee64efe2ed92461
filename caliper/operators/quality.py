"""Checks of keys, bounds and annotations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caliper.sources.readers import list_files


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def keys_without_rows(expected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key): the expected keys for which there is no row."""
    return expected.select(key).distinct().join(rows.select(key), key, "left_anti")


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(required))


def missing_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: rows, and for each required column those without it."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in required])


def expected_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: expected, actual, missing."""
    e, a = (df.agg(F.count(F.lit(1))).scalar() for df in (expected, actual))
    return expected.sparkSession.range(1).select(e.alias("expected"), a.alias("actual"), (e - a).alias("missing"))


def rename_conflicts(log: DataFrame, there: DataFrame, old: str, new: str, path: str) -> DataFrame:
    """(path, conflict): sources that are not there, targets that are."""
    gone = log.join(there, log[old] == there[path], "left_anti").select(F.col(old).alias("path"), F.lit("source missing").alias("conflict"))
    taken = log.join(there, log[new] == there[path], "left_semi").select(F.col(new).alias("path"), F.lit("target exists").alias("conflict"))
    return gone.unionByName(taken)


def rollback(log: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The change log that undoes a change log: each pair of old and new columns swapped."""
    swap = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    return log.select(*[F.col(swap.get(c, c)).alias(c) for c in log.columns])


def trusted_measurements(rows: DataFrame, entity: str, kind: str, annotator: str, trusted: str, order: str) -> DataFrame:
    """One row of each (entity, kind): a trusted annotator's where there is one for that kind, anyone's where there is none.

    A row stays if the entity has no trusted length and width at all, or it is trusted, or its kind is one for which the entity has
    no trusted row; then the first by `order`.
    """
    is_trusted = F.col(annotator) == trusted
    has = lambda k: F.bool_or(F.coalesce(is_trusted & (F.col(kind) == k), F.lit(False))).over(Window.partitionBy(entity))
    marked = rows.withColumn("__len", has("length")).withColumn("__wid", has("width"))
    keep = (~F.col("__len") & ~F.col("__wid")) | F.coalesce(is_trusted, F.lit(False)) | (~F.col("__len") & (F.col(kind) == "length")) | (~F.col("__wid") & (F.col(kind) == "width"))
    first = F.row_number().over(Window.partitionBy(entity, kind).orderBy(order))
    return marked.where(keep).withColumn("__n", first).where("__n = 1").drop("__n", "__len", "__wid")


def drop_invalid_elements(df: DataFrame, nested: str, valid: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """df with only the valid elements of a nested list, and the rows that lost some, as they were."""
    kept = F.filter(nested, valid)
    return df.withColumn(nested, kept), df.where(F.size(kept) < F.size(nested))


def larger_than_parent(child: DataFrame, parent: DataFrame, on: str, size: str, parent_size: str) -> DataFrame:
    return child.join(parent, on).where(F.col(size) >= F.col(parent_size))


def accuracy(valid: Column) -> list[Column]:
    """Aggregates: checked, valid, accuracy in percent."""
    n = F.count(valid)
    return [n.alias("checked"), F.count_if(valid).alias("valid"), (F.try_divide(F.count_if(valid).cast("double"), n) * 100).alias("accuracy")]


def listed_parts(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(part, length) of the folders part=N under path: the bytes of their data files."""
    number = F.regexp_extract("path", rf"/{part}=(\d+)/", 1).cast("bigint")
    return list_files(spark, path, "part-*").groupBy(number.alias(part)).agg(F.sum("length").alias("length"))


def file_problems(expected: DataFrame, found: DataFrame, key: str, least_bytes: int = 1) -> DataFrame:
    """(key, problem): expected files that are missing, or too short to hold anything."""
    both = expected.join(found, key, "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") < least_bytes, "empty")
    return both.select(key, problem.alias("problem")).where("problem is not null")
