"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.sources.scratch import written

#: Keys that join_hot sends to all tasks at most, and the rows from which a key may be one.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, which has one or a few small rows a key, without a task that gets all rows of a hot key. Keys
    with more than one HOT_KEYS-th of the rows of left, of which there are less than HOT_KEYS, are joined by broadcast. left
    is read three times: a written table."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c")).first()[0] or 0
    hot = counts.where(F.col("__c") > max(HOT_ROWS, total // HOT_KEYS)).select(key)
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, key)
    often = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key).unionByName(often)
