"""A folder that every executor can reach, for tables written between two steps of a query."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Of each open scope the tables that it drops at its end.
_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables that written() makes within are deleted at its end, but for those that are put into the list it gives, which
    later results read; these belong to the scope around it."""
    kept: list[DataFrame] = []
    made: list[tuple[SparkSession, str]] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        stay = {str(path) for df in kept for path in _folders(df)}
        for spark, path in made:
            if path.rsplit("/", 1)[-1] not in stay:
                _drop(spark, path)
            elif _scopes:
                _scopes[-1].append((spark, path))


def _folders(df: DataFrame) -> set[str]:
    """The names of the folders that df reads files of."""
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir or, where that is unset, under the session's warehouse; a cluster shares both."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: the rest of the plan starts from the files,
    so a lost executor costs a re-read, not a recomputation. The files go when the driver process ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"caliper-{name}")
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    if _scopes:
        _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that no later result reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or jsc is None:  # the session has ended
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    try:
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the gateway is down at exit; the folder's owner cleans it
        return
