
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules whose @query functions make up the catalog.
MODULES: tuple[str, ...] = ("caliper.plans.basics", "caliper.plans.aggregates", "caliper.plans.windows", "caliper.plans.values", "caliper.plans.files")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register f(tables) -> DataFrame under name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, root: f(Tables(spark, root))
        if sql:
            _ORACLES[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
