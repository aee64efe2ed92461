"""Grouped summaries of measurements and errors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from caliper.functions.stats import seeded_order
from caliper.operators.ordered import nearest_quantiles, weighted_mean, with_quantiles
from caliper.sources.readers import nan_to_null
from caliper.sources.scratch import written


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distinct_with_null(x: Column) -> Column:
    """Aggregate: distinct values, NULL being one of them."""
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def rate_under(x: Column, limit: float, count_name: str, pct_name: str) -> list[Column]:
    under = F.count_if(x < limit)
    return [under.alias(count_name), (F.try_divide(under.cast("double"), F.count(F.lit(1))) * 100).alias(pct_name)]


def last_known(x: str, order: str) -> Column:
    """Aggregate: the value of the last row in which it is not NULL."""
    return F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order)))


def merge_steps(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a step from rows that carry different metrics of it: the largest of each number, the first of the rest."""
    aggs = [F.max(f.name).alias(f.name) if isinstance(f.dataType, NumericType) else F.min_by(f.name, order).alias(f.name) for f in df.schema if f.name not in keys]
    return df.groupBy(*keys).agg(*aggs)


def across_runs(runs: DataFrame, key: str, x: str) -> DataFrame:
    """(key, lo, hi): the least and the largest value that any run gives an entity."""
    return runs.groupBy(key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def nan_summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, mean, max, median) that leave NaN out."""
    return with_quantiles(nan_to_null(df, [x]), keys, x, {"median": 0.5}, [weighted_mean(x).alias("mean"), F.max(x).alias("max")])


def validation_counters(df: DataFrame, nested: str, kind: str, valid: Callable, empty: Callable) -> DataFrame:
    """(kind, total, valid, out_of_bounds, empty) over the elements of a nested list."""
    m = df.select(F.explode(nested).alias("m"))
    e = F.col("m")
    return m.groupBy(e[kind].alias("kind")).agg(F.count(F.lit(1)).alias("total"), F.count_if(valid(e)).alias("valid"), F.count_if(~valid(e)).alias("out_of_bounds"), F.count_if(empty(e)).alias("empty"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for bins of equal width from 0; values outside count for the first or last bin."""
    at = F.floor((F.col(x) - low) / ((high - low) / bins))
    return df.where(F.col(x).isNotNull()).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, lo, q1, q2, q3, hi) with nearest-position quartiles."""
    return nearest_quantiles(df, keys, x, {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 1.0})


def cluster_coverage(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, priority, selected_share): of a cluster's priority rows, the share that was selected."""
    both = F.count_if(F.col("is_priority") & F.col("is_selected"))
    priority = F.count_if("is_priority")
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), priority.alias("priority"), F.try_divide(both.cast("double"), priority).alias("selected_share"))


#: Terms of the expansions and bins on either side. With bins one width wide, what 24 terms leave out is below 1e-14 of a
#: kernel, and what lies beyond 8 bins adds less than 1e-13.
TERMS, BINS = 24, 8


def _translations() -> list[tuple[int, list[list[float]]]]:
    """For each offset of bins d, in widths, the matrix that takes the moments of a bin to the Taylor coefficients of its kernel
    sum in the bin d further: with t = d / sqrt(2), entry (m, n) is (-1)^m / m! times the Hermite function of order n + m at t."""
    out = []
    for d in range(-BINS, BINS + 1):
        t = d / math.sqrt(2)
        h = [math.exp(-t * t), 2 * t * math.exp(-t * t)]
        for k in range(1, 2 * TERMS):
            h.append(2 * t * h[k] - 2 * k * h[k - 1])
        out.append((d, [[(-1) ** m / math.factorial(m) * h[n + m] for n in range(TERMS)] for m in range(TERMS)]))
    return out


def density(df: DataFrame, group: str, key: str, x: str, width: float) -> DataFrame:
    """(group, key, x, density): a Gaussian kernel estimate at each value within its group; NULL has none and does not count.

    A fast Gauss transform. Values lie in bins one width wide; a bin's kernel sum is given by TERMS moments of its values about
    the bin's centre. Bins hand their moments to the BINS bins on either side, where they add up to one Taylor series a bin,
    and each row evaluates its bin's series. No two values meet: work is linear in the rows, with a factor for the bins."""
    spark = df.sparkSession
    scale = 1 / (math.sqrt(2) * width)
    known = df.where(F.col(x).isNotNull() & F.col(group).isNotNull())
    bin_ = F.floor(F.col(x) / width).cast("bigint").alias("__bin")
    apart = ((F.col(x).cast("double") - (F.col("__bin") + 0.5) * width) * scale).alias("__u")
    placed = known.select(group, F.col(x).cast("double").alias(x), bin_).withColumn("__u", apart)
    moment = lambda n: F.sum(F.pow("__u", F.lit(float(n))) / float(math.factorial(n)))
    bins = placed.groupBy(group, "__bin").agg(F.count(F.lit(1)).alias("__c"), F.array(*[moment(n) for n in range(TERMS)]).alias("__moments"))
    bins = written(bins, "density-bins")
    table = F.broadcast(spark.createDataFrame(_translations(), "__d int, __matrix array<array<double>>"))
    dot = lambda row: F.aggregate(F.zip_with(row, "__moments", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    sent = bins.select(group, "__bin", "__moments", F.explode(F.sequence(F.lit(-BINS), F.lit(BINS))).alias("__d")).join(table, "__d")
    sent = sent.select(group, (F.col("__bin") + F.col("__d")).alias("__bin"), F.transform("__matrix", dot).alias("__series"))
    series = sent.groupBy(group, "__bin").agg(F.array(*[F.sum(F.get("__series", F.lit(m))) for m in range(TERMS)]).alias("__series"))
    totals = bins.groupBy(group).agg(F.sum("__c").alias("__n"))
    series = bins.select(group, "__bin").join(series, [group, "__bin"]).join(totals, group)
    rows = df.select(group, key, x, bin_).withColumn("__u", apart).join(series, [group, "__bin"], "left")
    total = F.get("__series", F.lit(TERMS - 1))
    for m in range(TERMS - 2, -1, -1):
        total = total * F.col("__u") + F.get("__series", F.lit(m))
    return rows.select(group, key, x, (total / F.col("__n") / (width * math.sqrt(2 * math.pi))).alias("density"))


def seeded_per_group(df: DataFrame, group: Sequence[str], key: Column, seed: int, n: int) -> DataFrame:
    """n rows of each group in a seeded order."""
    w = Window.partitionBy(*group).orderBy(seeded_order(key, seed))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def measured(measurements: Column, kinds: Sequence[str]) -> Column:
    """The coordinates of the first measurement of each kind, one flat list; four NULLs where there is none."""
    none = F.array(*[F.lit(None).cast("double")] * 4)
    first = lambda k: F.coalesce(F.get(F.filter(measurements, lambda m: m["kind"] == k), F.lit(0))["xy"], none)
    return F.flatten(F.array(*[first(k) for k in kinds]))


def nested_index(df: DataFrame, keys: Sequence[str], kind: str, points: str, name: str) -> DataFrame:
    """(keys, name): a map from kind to all its points."""
    lists = df.groupBy(*keys, kind).agg(F.flatten(F.collect_list(points)).alias("p"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(kind, "p"))).alias(name))
