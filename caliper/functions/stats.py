"""Statistics that built-in functions do not give with the wanted conventions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def quota(size: Column, total: Column, budget: float) -> Column:
    """A group's share of a budget by size, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.rint(size / total * budget).cast("long"))


def percent_error(error: Column, truth: Column) -> Column:
    """100 * error / truth in double; NULL where the truth is 0 or NULL."""
    return F.try_divide(error.cast("double"), truth.cast("double")) * 100


def log10(x: Column) -> Column:
    """The decimal logarithm in IEEE doubles: -inf at 0 and NaN below, where the built-in one gives NULL; NULL stays NULL."""
    x = x.cast("double")
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.log10(x))


def masked_mean(x: Column, weight: Column) -> Column:
    """Aggregate: weighted mean whose weights count as 1 at least."""
    return F.sum(x * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def rmse(a: Column, b: Column) -> Column:
    """Aggregate: root of the mean squared difference."""
    return F.sqrt(F.avg((a - b) * (a - b)))


def running(agg: Column, order: WindowSpec, including: bool = True) -> Column:
    """A running aggregate up to the current row, or up to the one before it."""
    return agg.over(order.rowsBetween(Window.unboundedPreceding, 0 if including else -1))


def seeded_order(key: Column, seed: int) -> Column:
    """A sort key that is random in its order and equal on every engine: md5 of 'seed|key'."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def seeded_bucket(key: Column, seed: int, n: int) -> Column:
    """0 to n-1 by the leading 32 bits of seeded_order."""
    return F.pmod(F.conv(F.substring(seeded_order(key, seed), 1, 8), 16, 10).cast("long"), F.lit(n))
