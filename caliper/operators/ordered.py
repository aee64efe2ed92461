"""Ranks, places and quantiles of groups that no task could hold.

Values are counted first, with map-side combine. Approximate percentiles, which have a bounded size, cut each group into
ranges; a range's start is a running sum over the group's few ranges, and positions within a range are a window over that
range alone. The results are exact: the percentiles only decide where the cuts are. Groups are one struct column inside, in
which NULL equals NULL, so that NULL keys are groups like others and no keys are one group.

Where a count says that no group has more than GROUP_ROWS rows, quantiles are aggregates that hold a group's values instead: one
shuffle of what the tasks have combined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.sources.scratch import written

RANGES = 64
#: Rows of a group whose values an aggregate may hold.
GROUP_ROWS = 200_000
KEY = "__key"


def _key(keys: Sequence[str], x: str | None = None) -> Column:
    """x: a column without NULLs, from which the one group of no keys gets a value that is no constant (joins on constants
    become cross joins)."""
    return F.struct((F.col(x).isNull() if x and not keys else F.lit(False)).alias("__"), *keys).alias(KEY)


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{KEY}.{k}").alias(k) for k in keys]


def _before(counts: DataFrame, part: str) -> DataFrame:
    """(KEY, part, __start, __total) of counts (KEY, part, n): the group's rows in earlier parts, and all of them."""
    group = Window.partitionBy(KEY)
    earlier = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(KEY, part).agg(F.sum("n").alias("__n"))
    return sums.select(KEY, part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), F.sum("__n").over(group).alias("__total"))


def _counts(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(KEY, x, n): the different values of each group, NULL among them, and their rows."""
    return df.groupBy(_key(keys, x), x).agg(F.count(F.lit(1)).alias("n"))


def _counts_before(counts: DataFrame, x: str, ranges: int = RANGES) -> DataFrame:
    """(KEY, x, n, before, __total) of _counts, without NULL."""
    counts = counts.where(F.col(x).isNotNull())
    cuts = counts.groupBy(KEY).agg(F.percentile_approx(x, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1000)).alias("__cuts"))
    place = F.array_position(F.sort_array(F.array_append("__cuts", F.col(x))), F.col(x))  # 1 + the number of smaller cuts
    cut = counts.join(cuts, KEY).withColumn("__range", place).drop("__cuts")
    within = Window.partitionBy(KEY, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("__at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(_before(cut, "__range"), [KEY, "__range"])
    return placed.select(KEY, x, "n", (F.col("__start") + F.col("__at")).alias("before"), "__total")


def counts_before(df: DataFrame, keys: Sequence[str], x: str, ranges: int = RANGES) -> DataFrame:
    """(keys, x, n, before): each distinct non-null value of a group, its rows, and the group's rows with smaller values."""
    return _counts_before(_counts(df, keys, x), x, ranges).select(*_keys(keys), x, "n", "before")


def _at_positions(counts: DataFrame, x: str, positions: dict[str, Column]) -> DataFrame:
    """(KEY, __total, the value at each position from 0); positions are expressions of __total."""
    placed = _counts_before(counts, x)
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    return placed.groupBy(KEY, "__total").agg(*[F.max(F.when(holds(at), F.col(x))).alias(name) for name, at in positions.items()])


def _groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return (sizes.agg(F.max("__n")).first()[0] or 0) <= GROUP_ROWS


def _percentile(x: str, q: float) -> Column:
    return F.percentile(F.col(x).cast("double"), F.lit(q))


def nearest_quantiles(df: DataFrame, keys: Sequence[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, a column for each quantile): the value at position round(q * (n - 1)), half to even, of the sorted values."""
    if _groups_fit(df, keys):
        lists = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias("__v")).where(F.size("__v") > 0)
        place = lambda q: F.rint(F.lit(q) * (F.size("__v") - 1)).cast("int")
        return lists.select(*keys, *[F.get("__v", place(q)).alias(name) for name, q in quantiles.items()])
    at = {name: F.rint(F.lit(q) * (F.col("__total") - 1)).cast("bigint") for name, q in quantiles.items()}
    return _at_positions(_counts(df, keys, x), x, at).select(*_keys(keys), *quantiles)


def _interpolated(counts: DataFrame, x: str, quantiles: dict[str, float]) -> DataFrame:
    at, out = {}, []
    for name, q in quantiles.items():
        p = F.lit(q) * (F.col("__total") - 1)
        low, high = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        at |= {f"__lo_{name}": F.floor(p), f"__hi_{name}": F.ceil(p)}
        out.append((low + (high - low) * (p - F.floor(p))).alias(name))
    return _at_positions(counts, x, at).select(KEY, *out)


def interpolated_quantiles(df: DataFrame, keys: Sequence[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, a column for each quantile): the value at position q * (n - 1) of the sorted values, in double, linear between
    the two nearest. Groups without a value have no row."""
    if _groups_fit(df, keys):
        held = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(*[_percentile(x, q).alias(name) for name, q in quantiles.items()], F.count(F.lit(1)).alias("__n"))
        return held.where(F.col("__n") > 0).select(*keys, *quantiles)
    return _interpolated(_counts(df, keys, x), x, quantiles).select(*_keys(keys), *quantiles)


def weighted_mean(x: str) -> Column:
    """Aggregate of with_quantiles: the mean of x; NULL values do not count."""
    return F.sum(F.col(x) * F.col("n")) / F.sum(F.when(F.col(x).isNotNull(), F.col("n")))


def with_quantiles(df: DataFrame, keys: Sequence[str], x: str, quantiles: dict[str, float], aggs: Sequence[Column]) -> DataFrame:
    """(keys, aggs, a column for each interpolated quantile of x, NULL in groups without a value). aggs are aggregates over the
    different values x of a group and their rows `n`: df is read once."""
    if _groups_fit(df, keys):
        rows = df.select(*keys, x, F.lit(1).cast("bigint").alias("n"))
        return rows.groupBy(*keys).agg(*aggs, *[_percentile(x, q).alias(name) for name, q in quantiles.items()])
    counts = _counts(df, keys, x)
    sums = counts.groupBy(KEY if keys else _key(keys)).agg(*aggs)
    found = _interpolated(counts, x, quantiles).withColumn(KEY, F.col(KEY) if keys else _key(keys))
    names = [c for c in sums.columns if c != KEY]
    both = sums.unionByName(found, allowMissingColumns=True).groupBy(KEY)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*names, *quantiles)]).select(*_keys(keys), *names, *quantiles)


def with_percentile_rank(df: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """df with the average-method rank of x over the group's size, in (0, 1]; NULL values have none and do not count."""
    placed = _counts_before(_counts(df, keys, x), x)
    ranks = placed.select(KEY, x, ((F.col("before") + (F.col("n") + 1) / 2.0) / F.col("__total")).alias(name))
    return df.select("*", _key(keys, x)).join(ranks, [KEY, x], "left").select(*df.columns, name)


def placed_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """df with `name`, the row's place from 1 within its group, and `total`, the group's rows. The order must leave no ties.

    Rows are parted by ranges of (group, order) and written, so that the parts stay what they are; each part numbers its own
    rows from the group's rows in the parts before it. For groups of any size; rows of a small group are numbered by a window.
    """
    ranged = df.select("*", _key(group)).repartitionByRange(KEY, *order)
    parts = written(ranged.withColumn("__part", F.spark_partition_id()), "places")
    counts = parts.groupBy(KEY, "__part").agg(F.count(F.lit(1)).alias("n"))
    within = F.row_number().over(Window.partitionBy(KEY, "__part").orderBy(*order))
    out = parts.withColumn("__at", within).join(_before(counts, "__part"), [KEY, "__part"])
    place = (F.col("__start") + F.col("__at")).cast("bigint").alias(name)
    return out.select(*df.columns, place, *([F.col("__total").alias(total)] if total else []))


#: Values at the head of a run that are folded one by one: as long as their averages have few digits, they round like the
#: recurrence itself.
HEAD = 32
#: The factor by which a block of a run damps what comes before it, and the blocks after which nothing of a double is left.
DAMPING, BLOCKS_BACK = 1e-100, 7


def running_ema(df: DataFrame, run: str, order: str, x: str, beta: float) -> DataFrame:
    """(run, step from 1, ema): the exponential moving average of each run, seeded by its first value; a NULL or NaN value keeps
    it, and before the first value it is NULL. (run, order) is unique; 0 < beta < 1. NULL runs are a run.

    A step is the affine map e -> beta * e + (1 - beta) * x, and so is a block of steps. Runs are cut into blocks of as many
    values as damp their past by DAMPING; a window gives each row the average of its block alone, and what a block starts with
    comes from the averages of the BLOCKS_BACK blocks before it, as all older ones are damped below the smallest double. So
    neither a run nor its blocks pass one task. Rows are numbered by ranges, like placed_within."""
    if not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    length = max(1, math.floor(math.log(DAMPING) / math.log(beta)))
    value = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
    rows = df.select(_key([run]), F.col(order).alias("__order"), value.alias("__x"))
    parts = written(rows.repartitionByRange(KEY, "__order").withColumn("__part", F.spark_partition_id()), "ema-parts")
    sums = parts.groupBy(KEY, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.count("__x").alias("__values"))
    earlier = Window.partitionBy(KEY).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(KEY, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__rows", "__values")])
    within = Window.partitionBy(KEY, "__part").orderBy("__order")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumns({"__row": F.row_number().over(within), "__nth": F.count("__x").over(so_far)}).join(starts, [KEY, "__part"])
    nth = F.col("__values") + F.col("__nth")
    step, block = (F.col("__rows") + F.col("__row")).cast("bigint"), F.floor((nth - 1) / length).cast("bigint")
    blocked = numbered.select(KEY, step.alias("step"), "__x", block.alias("__block"), (nth - block * length).alias("__k"))
    weight = F.when((F.col("__block") == 0) & (F.col("__k") == 1), 1.0).otherwise(1 - beta) * F.pow(F.lit(beta), -F.col("__k"))
    in_block = Window.partitionBy(KEY, "__block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    own = F.pow(F.lit(beta), F.col("__k")) * F.sum(F.col("__x") * weight).over(in_block)
    alone = written(blocked.withColumn("__own", F.when(F.col("__block") >= 0, own)), "ema-alone")
    first = alone.where((F.col("__block") == 0) & (F.col("__k") <= HEAD) & F.col("__x").isNotNull()).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("__k", "__x"))).alias("__v"))
    fold = F.aggregate(F.slice("__v", 2, HEAD), F.array(F.col("__v")[0]["__x"]), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) * beta + v["__x"] * (1 - beta)))
    head = first.select(KEY, F.lit(0).cast("bigint").alias("__block"), F.posexplode(fold).alias("__at", "__folded")).withColumn("__k", (F.col("__at") + 1).cast("bigint")).drop("__at")
    ends = alone.where((F.col("__k") == length) & (F.col("__block") >= 0)).groupBy(KEY, "__block").agg(F.first("__own").alias("__end"))
    later = F.explode(F.sequence(F.lit(1), F.lit(BLOCKS_BACK))).alias("__later")
    reach = ends.select(KEY, "__block", "__end", later).select(KEY, (F.col("__block") + F.col("__later")).alias("__block"), (F.col("__end") * F.pow(F.lit(beta**length), F.col("__later") - 1)).alias("__part_of"))
    begin = reach.groupBy(KEY, "__block").agg(F.sum("__part_of").alias("__begin"))
    ema = F.col("__own") + F.coalesce(F.pow(F.lit(beta), F.col("__k")) * F.col("__begin"), F.lit(0.0))
    both = alone.join(begin, [KEY, "__block"], "left").join(head, [KEY, "__block", "__k"], "left")
    return both.select(*_keys([run]), "step", F.coalesce("__folded", ema).alias("ema"))
