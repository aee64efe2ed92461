"""Writers. Nothing overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def lists_as_text(df: DataFrame, sep: str = ",") -> DataFrame:
    """Every list column as its elements joined by sep, which a CSV file can hold."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), sep) for c in lists})


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file only for reports of a known small size."""
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def remap_keys(df: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """df with `key` replaced where renames (old, new) names it; write the result to a new path, then swap."""
    r = renames.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return df.join(r, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).drop("__old", "__new")
