"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.sources.scratch import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (u, v): component is the smallest id of the node's component.

    Ids are of any type that has an order. Loops and repeated edges change nothing; rows with a null end are left out; no
    edges give no rows. Every round is a few aggregations and joins over a written table, whatever the size of a component or
    the degree of a node.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print_of(now)
    while True:
        after = written(_small_star(_large_star(now)), "edges")
        drop(now)
        now, was, seen = after, seen, _print_of(after)
        if seen == was:
            roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
