"""Readers: explicit schemas, a null vocabulary, nested JSON documents as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

#: Tokens that stand for a missing value in specimen metadata files.
NULL_TOKENS = ("NA", "N/A", "", "-Inf")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, or ValueError naming the columns that it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def missing_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(missing): the names that df has no column for."""
    return df.sparkSession.createDataFrame([(n,) for n in names if n not in df.columns], "missing string")


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN measurements as NULL, so that aggregates leave them out."""
    floats = [c for c, t in df.dtypes if t in ("float", "double")]
    chosen = [c for c in floats if columns is None or c in columns]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen})


def read_runs(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Result files of several runs as one table; run_id is the file's name without its ending."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1)
    return df.withColumn("run_id", name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null_tokens: Sequence[str] = ()) -> DataFrame:
    """CSV with a header. With null tokens all fields are read as text, the tokens become NULL, and what then does not
    parse as its type is NULL too."""
    if not null_tokens:
        return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    text = StructType()
    for f in wanted:
        text.add(f.name, StringType())
    raw = spark.read.csv(path, header=True, schema=text)
    known = lambda c: F.when(~F.col(c).isin(*null_tokens), F.col(c))
    return raw.select(*[(known(f.name) if isinstance(f.dataType, StringType) else known(f.name).try_cast(f.dataType)).alias(f.name) for f in wanted])


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array of objects, an object a row."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_keyed_json(spark: SparkSession, path: str, value_type: str, key: str = "key") -> DataFrame:
    """A file that holds one JSON object of objects: a row for each key, with the value's fields as columns."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias(key, "value"))
    return pairs.select(key, "value.*")


def read_indexed_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with `images` and `annotations` arrays, an annotation a row beside its image; an annotation names its image
    by the image's position."""
    doc = spark.read.json(path, schema=schema, multiLine=True)
    images = doc.select(F.posexplode("images").alias("image_id", "image"))
    annotations = doc.select(F.explode("annotations").alias("a")).select("a.*")
    return annotations.join(images, "image_id")


def candidate_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(place from 1, candidate, there, chosen) of candidate paths, in any file system that Spark reads; chosen is the first that
    is there."""
    there = [_exists(spark, p) for p in paths]
    chosen = there.index(True) if True in there else -1
    return spark.createDataFrame([(i + 1, p, x, i == chosen) for i, (p, x) in enumerate(zip(paths, there, strict=True))], "place int, candidate string, there boolean, chosen boolean")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of the candidate paths that there is; ValueError if there is none."""
    for path in paths:
        if _exists(spark, path):
            return path
    raise ValueError(f"none of these exists: {', '.join(paths)}")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, names and lengths of the files under a folder, without their contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def history_rows(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Exported run history, a logged step a row, as (ids, metric, value): '/' in names becomes '_', only finite numbers."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in ids]
    plain = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c.replace("/", "_")) for c in numbers])
    long = plain.unpivot(list(ids), [c.replace("/", "_") for c in numbers], "metric", "value")
    return long.where(is_finite(F.col("value")))


def is_finite(x: Column) -> Column:
    """Neither NaN nor infinite; NULL for NULL."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every struct field at any depth as a column named by its path."""

    def leaves(schema: StructType, path: tuple[str, ...]):
        for f in schema:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in leaves(df.schema, ())])
