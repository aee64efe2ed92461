"""Expressions on lists and polylines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, not once for each element of a lambda that mentions it."""
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def to_points(flat: Column, ox: Column, oy: Column) -> Column:
    """[x0, y0, x1, y1, ...] as [[x0-ox, y0-oy], ...]."""
    pair = lambda i: F.array(flat[2 * i] - ox, flat[2 * i + 1] - oy)
    return F.when(F.size(flat) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), pair)).otherwise(F.array().cast("array<array<double>>"))


def rebased(flat: Column, ox: Column, oy: Column) -> Column:
    """A flat polyline with the origin moved to (ox, oy); NULL if its length is odd or below 2."""
    moved = F.transform(flat, lambda x, i: x - F.when(i % 2 == 0, ox).otherwise(oy))
    return F.when((F.size(flat) >= 2) & (F.size(flat) % 2 == 0), moved)


def ends(points: Column) -> Column:
    """First and last point, flat."""
    return F.concat(F.get(points, F.lit(0)), F.element_at(points, -1))


def in_bounds(flat: Column, width: Column, height: Column, tolerance: float) -> Column:
    """Every point of a flat polyline lies in the image, or at most `tolerance` beyond it."""
    marked = F.transform(flat, lambda x, i: x.between(-tolerance, F.when(i % 2 == 0, width).otherwise(height) + tolerance))
    return F.forall(marked, lambda x: x)
