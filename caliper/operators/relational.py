"""Joins, set operations and reshapes as DataFrame functions. Join strategies are left to the optimizer."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.operators.components import connected_components
from caliper.operators.ordered import placed_within, weighted_mean, with_quantiles
from caliper.sources.readers import is_finite
from caliper.sources.scratch import drop, written


def _on(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, Column]:
    r = right.select(*[F.col(b).alias(f"__{i}") for i, b in enumerate(keys.values())])
    return r, reduce(lambda x, y: x & y, [left[a] == r[f"__{i}"] for i, a in enumerate(keys)])


def absent(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of left without a partner in right; a NULL key has none."""
    r, on = _on(left, right, keys)
    return left.join(r, on, "left_anti")


def present(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    r, on = _on(left, right, keys)
    return left.join(r, on, "left_semi")


def orphans(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(side, key) of the rows of either table without a partner in the other."""
    a = absent(left, right, {key: key}).select(F.lit(left_name).alias("side"), key)
    return a.unionByName(absent(right, left, {key: key}).select(F.lit(right_name).alias("side"), key))


def left_join_suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    renamed = right.select(*keys, *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys])
    return left.join(renamed, list(keys), "left")


def children(df: DataFrame, parent: str, order: str, value: str, name: str) -> DataFrame:
    """(parent, name): the values of a parent's rows as a list in the given order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(parent).agg(F.transform(pairs, lambda s: s[value]).alias(name))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on the left only, on the right only."""
    a = left.select(key).distinct().withColumn("a", F.lit(True))
    b = right.select(key).distinct().withColumn("b", F.lit(True))
    both = a.join(b, key, "full_outer")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return both.agg(n(F.col("a") & F.col("b"), "both_sides"), n(F.col("a") & F.col("b").isNull(), "left_only"), n(F.col("b") & F.col("a").isNull(), "right_only"))


def align_runs(runs: Sequence[DataFrame], key: str) -> DataFrame:
    """Runs side by side by key, columns numbered by run; ValueError if two runs hold different keys."""
    first = runs[0]
    for i, other in enumerate(runs[1:], 1):
        if not absent(first, other, {key: key}).isEmpty() or not absent(other, first, {key: key}).isEmpty():
            raise ValueError(f"run {i} does not hold the keys of run 0")
    numbered = [r.select(key, *[F.col(c).alias(f"{c}_{i}") for c in r.columns if c != key]) for i, r in enumerate(runs)]
    return reduce(lambda a, b: a.join(b, key), numbered)


def tag_seen(df: DataFrame, train: DataFrame, key: str, name: str) -> DataFrame:
    known = train.select(key).distinct().withColumn("__seen", F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.when(F.col("__seen"), "seen").otherwise("unseen")).drop("__seen")


#: Rows of a group that are compared with one another.
GROUP_ROWS = 32


def pairs_within(df: DataFrame, group: str, order: str, near: dict[str, float]) -> DataFrame:
    """(group, a, b): pairs of rows of a group with a before b in `order` (unique in the group) of which at least one of the
    columns of `near` differs by its tolerance at most. NULL and NaN are near nothing; a NULL group has no pairs.

    Groups of GROUP_ROWS rows at most are gathered in one shuffle and compared row by row. The others take a band join: each
    column cuts the group into bands twice as wide as its tolerance, and rows meet those of their own and of the two next bands
    only. A good part of the rows of a band are near one another, so that the work is in proportion to the rows and the pairs,
    not to the square of the group. A pair that is near by several columns comes from the first of them."""

    def bands(by: int, c: str, steps: Sequence[int]) -> list[Column]:
        v, width = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), 2.0 * near[c]
        at = F.floor(v / width).cast("double") if width else v
        beside = lambda k: F.when(F.abs(at) < 2.0**51, at + float(k)) if width else F.lit(None).cast("double")  # noqa: E731  beyond, a double has no next band
        return [F.struct(F.lit(by).alias("by"), (beside(k) if k else at).alias("at")) for k in steps]

    rows = df.where(F.col(group).isNotNull())
    sizes = rows.groupBy(F.col(group).alias("__banded")).agg(F.count(F.lit(1)).alias("__n"))
    large = written(sizes.where(F.col("__n") > GROUP_ROWS).select("__banded"), "large-groups")
    in_large = rows[group] == large["__banded"]
    wide, few = rows.join(large, in_large, "left_semi"), rows.join(large, in_large, "left_anti")

    def banded(side: str, steps: Sequence[int]) -> DataFrame:
        all_ = F.array(*[x for i, c in enumerate(near) for x in bands(i, c, steps)])
        placed = wide.select(*df.columns, F.explode(all_).alias("__in")).where("__in.at is not null")
        return placed.select(*[F.col(c).alias(f"__{side}_{c}") for c in df.columns], F.col("__in").alias(f"__{side}"), F.xxhash64(group, "__in").alias("__band"))

    a, b = (lambda c: F.col(f"__a_{c}")), (lambda c: F.col(f"__b_{c}"))
    is_near = lambda x, y, c: F.coalesce(F.nanvl(F.abs(x(c) - y(c)).cast("double"), F.lit(None)) <= near[c], F.lit(False))
    first = reduce(lambda rest, c: F.when(is_near(a, b, c[1]), c[0]).otherwise(rest), reversed(list(enumerate(near))), F.lit(-1))
    pairs = banded("a", (-1, 0, 1)).join(banded("b", (0,)), "__band")
    same = (a(group) == b(group)) & (F.col("__a") == F.col("__b"))  # a hash may stand for several bands
    found = pairs.where(same & (a(order) < b(order)) & (first == F.col("__a.by")))
    whole = lambda side: F.struct(*[F.col(f"__{side}_{c}").alias(c) for c in df.columns]).alias(side)

    rest = [c for c in df.columns if c != group]
    gathered = few.groupBy(group).agg(F.collect_list(F.struct(*rest)).alias("__rows")).where(F.size("__rows") > 1)
    each = gathered.select(group, "__rows", F.explode("__rows").alias("__x")).select(group, "__x", F.explode("__rows").alias("__y"))
    x, y = (lambda c: F.col(f"__x.{c}")), (lambda c: F.col(f"__y.{c}"))
    met = each.where((x(order) < y(order)) & reduce(lambda p, q: p | q, [is_near(x, y, c) for c in near]))
    full = lambda side, to: F.struct(*[F.col(group) if c == group else F.col(f"{side}.{c}").alias(c) for c in df.columns]).alias(to)
    return met.select(group, full("__x", "a"), full("__y", "b")).unionByName(found.select(a(group).alias(group), whole("a"), whole("b")))


def error_summary(df: DataFrame, group: str, error: str) -> DataFrame:
    """(group, n, median, mean) of the finite errors."""
    aggs = [F.sum("n").alias("n"), weighted_mean(error).alias("mean")]
    return with_quantiles(df.where(is_finite(F.col(error))), [group], error, {"median": 0.5}, aggs).select(group, "n", "median", "mean")


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in ascending order, all columns; an aggregate, so that a large group is combined before
    it is shuffled."""
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*group).agg(first).select(*[F.col(c) if c in group else F.col(f"__first.{c}").alias(c) for c in df.columns])


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with the row's number within its group, by a window: for the first rows of each group and for groups that fit into a
    task; ordered.placed_within is for groups of any size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def pivot_first(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str, order: str | None = None) -> DataFrame:
    """A column for each of the named values; of several rows the first in the order."""
    agg = F.min_by(value, order) if order else F.min(value)
    return df.groupBy(*index).pivot(column, list(values)).agg(agg)


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Same-schema tables one below the other, tagged by run_id."""
    return reduce(DataFrame.unionByName, [df.withColumn("run_id", F.lit(k)) for k, df in runs.items()])


def last_source_wins(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which a key is taken from the last source that has it."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("__src", F.lit(i)) for i, df in enumerate(sources)])
    return first_per_group(tagged, [key], [(-F.col("__src")).alias("o")]).drop("__src")


def proportional_mix(sources: Sequence[DataFrame], order: str) -> DataFrame:
    """Union with a sort key that spreads each source evenly over (0, 1), by unique values of `order`."""
    all_ = reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources)])
    placed = placed_within(all_, ["source"], [F.col(order)], "__at", "__n")
    return placed.withColumn("at", (F.col("__at") - 0.5) / F.col("__n")).drop("__at", "__n")


#: Boxes of a cell that are compared with one another, and the rounds after which those of larger cells are.
CELL_BOXES, CELL_ROUNDS = 64, 200
_CELL = ("image", "lx", "ly")  # cells are disjoint, so that their lower corners tell them apart


def _halved(known: DataFrame) -> DataFrame:
    """The rows of known (with n, and the bounds bx0 .. by1 of the cell's contents) with `hub`, the smallest box of the cell
    that overlaps all others of it, if one is known to; where none is, with `by_x` and `mid`, the cut that fewer boxes cross."""
    x0, x1, y0, y1 = F.greatest("x0", "lx"), F.least("x1", "hx"), F.greatest("y0", "ly"), F.least("y1", "hy")
    mid = lambda lo, hi: F.when(F.col(lo) + (F.col(hi) - F.col(lo)) / 2 > F.col(lo), F.col(lo) + (F.col(hi) - F.col(lo)) / 2).otherwise(F.col(hi))
    cut = known.withColumns({"mx": mid("bx0", "bx1"), "my": mid("by0", "by1")})
    whole = (x0 <= F.col("bx0")) & (x1 >= F.col("bx1")) & (y0 <= F.col("by0")) & (y1 >= F.col("by1"))
    on_x, on_y = (F.col("x0") < F.col("mx")) & (F.col("x1") >= F.col("mx")), (F.col("y0") < F.col("my")) & (F.col("y1") >= F.col("my"))
    counts = cut.groupBy(*_CELL).agg(
        F.min(F.when(whole, F.col("id"))).alias("covers"), F.min("id").alias("least"), F.count_if(on_x).alias("across_x"), F.count_if(on_y).alias("across_y"), F.first("n").alias("all"),
        *[F.first(c).alias(f"c_{c}") for c in ("mx", "my", "bx0", "bx1", "by0", "by1")],
    )
    wide, high = F.col("c_bx1") > F.col("c_bx0"), F.col("c_by1") > F.col("c_by0")
    centre = (F.col("across_x") == F.col("all")) & (F.col("across_y") == F.col("all"))  # all boxes hold one point
    by_x = F.when(~wide, False).when(~high, True).otherwise(F.col("across_x") <= F.col("across_y"))
    told = counts.select(*_CELL, F.coalesce("covers", F.when(centre, F.col("least"))).alias("hub"), by_x.alias("by_x"), F.when(by_x, F.col("c_mx")).otherwise(F.col("c_my")).alias("mid"))
    return known.select("image", "id", "x0", "x1", "y0", "y1", "lx", "hx", "ly", "hy").join(told, list(_CELL))


def _box_links(boxes: DataFrame, cell: float) -> DataFrame:
    """(image, id, hub): links of boxes (image, id, x0, x1, y0, y1) that overlap, enough to join all that hang together."""
    side = 2.0 ** math.floor(math.log2(cell))  # by which a double is divided without rounding
    over = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    placed = boxes.withColumn("cx", over("x0", "x1")).withColumn("cy", over("y0", "y1"))
    edge = lambda c, k: ((F.col(c) + k) * F.lit(side)).cast("double")
    open_ = written(placed.withColumns({"lx": edge("cx", 0), "hx": edge("cx", 1), "ly": edge("cy", 0), "hy": edge("cy", 1)}).drop("cx", "cy"), "boxes")
    links, step = [], 0
    while True:
        step += 1
        x0, x1, y0, y1 = F.greatest("x0", "lx"), F.least("x1", "hx"), F.greatest("y0", "ly"), F.least("y1", "hy")
        cells = open_.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"), F.min(x0).alias("bx0"), F.max(x1).alias("bx1"), F.min(y0).alias("by0"), F.max(y1).alias("by1")).where("n > 1")
        known = written(open_.join(cells, list(_CELL)), "boxes")
        drop(open_)
        few = F.lit(step > CELL_ROUNDS) | (F.col("n") <= CELL_BOXES)
        a = known.where(few).alias("a")
        b = known.where(few).select(*_CELL, *[F.col(c).alias(f"b_{c}") for c in ("id", "x0", "x1", "y0", "y1")]).alias("b")
        meet = (F.col("x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("x1")) & (F.col("y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("y1"))
        here = (F.greatest("x0", "b_x0") >= F.col("lx")) & (F.greatest("x0", "b_x0") < F.col("hx")) & (F.greatest("y0", "b_y0") >= F.col("ly")) & (F.greatest("y0", "b_y0") < F.col("hy"))
        pairs = a.join(b, list(_CELL)).where((F.col("id") < F.col("b_id")) & meet & here)
        links.append(written(pairs.select("image", F.col("b_id").alias("id"), F.col("id").alias("hub")), "box-links"))
        many = known.where(~few)
        if many.isEmpty():
            drop(known)
            return reduce(DataFrame.unionByName, links)
        told = written(_halved(many), "boxes")
        drop(known)
        links.append(told.where("hub is not null and id <> hub").select("image", "id", "hub"))
        lo, hi, m = F.when(F.col("by_x"), F.col("x0")).otherwise(F.col("y0")), F.when(F.col("by_x"), F.col("x1")).otherwise(F.col("y1")), F.col("mid")
        halves = F.array(F.when(lo < m, F.lit(0)), F.when(hi >= m, F.lit(1)))
        cut = told.where("hub is null").withColumn("half", F.explode(halves)).where("half is not null")
        moved = {c: F.when(F.col("by_x").eqNullSafe(F.lit(x)) & (F.col("half") == half), m).otherwise(F.col(c)) for c, x, half in (("lx", True, 1), ("hx", True, 0), ("ly", False, 1), ("hy", False, 0))}
        open_ = written(cut.withColumns(moved).drop("hub", "by_x", "mid", "half"), "boxes")


def merge_boxes(boxes: DataFrame, image: str, cell: float, overlap: str = "x0 x1 y0 y1") -> DataFrame:
    """boxes (image, id, ..) with `component`: the smallest id of the boxes that overlap it, directly or through others, in
    its image; borders count. (image, id) is unique.

    Boxes lie in the cells of a grid, `cell` wide, which should be about a box's side. Of a cell with few boxes all pairs are
    compared, each in the one cell that holds the corner of its overlap. In a fuller one, all boxes overlap any that covers the
    extent of the cell's contents, so that one link a box does; where no box covers it, the cell is halved. Piles of boxes
    thereby cost links in proportion to the boxes, not to their pairs. Equal boxes count once. Boxes with a NULL or NaN
    bound, or with bounds that are the wrong way round, overlap nothing."""
    x0, x1, y0, y1 = overlap.split()
    sides = {f"__{k}": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for k, c in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))}
    same = [image, *sides]
    real = boxes.withColumns(sides).where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in same]) & (F.col("__x0") <= F.col("__x1")) & (F.col("__y0") <= F.col("__y1"))).select(*same, "id")
    first = written(real.groupBy(*same).agg(F.min("id").alias("__first")), "boxes")
    links = _box_links(first.select(F.col(image).alias("image"), F.col("__first").alias("id"), *[F.col(c).alias(c[2:]) for c in sides]), cell)
    # A box hangs on its smallest hub; its other links become links between hubs, of which there are few.
    links = written(links.distinct(), "box-links")
    homes = written(links.groupBy("image", "id").agg(F.min("hub").alias("home")), "boxes")
    node = lambda c: F.struct("image", F.col(c).alias("id"))
    hubs = links.select("image", F.col("hub").alias("id")).distinct().join(homes, ["image", "id"]).select(node("id").alias("u"), node("home").alias("v"))
    moved = links.join(homes, ["image", "id"]).where("hub <> home").select(node("home").alias("u"), node("hub").alias("v")).distinct()
    roots = connected_components(moved.unionByName(hubs)).select("id.*", F.col("component.id").alias("root"))
    at = homes.select("image", "id", "home").unionByName(links.select("image", F.col("hub").alias("id"), F.col("hub").alias("home")).distinct()).groupBy("image", "id").agg(F.min("home").alias("home"))
    rooted = at.join(roots.withColumnRenamed("id", "home"), ["image", "home"], "left").select("image", "id", F.coalesce("root", "home").alias("root"))
    least = rooted.groupBy("image", "root").agg(F.min("id").alias("least"))
    found = rooted.join(least, ["image", "root"]).select(F.col("image").alias(image), F.col("id").alias("__first"), "least")
    known = first.join(found, [image, "__first"], "left").select(*same, F.coalesce("least", "__first").alias("__least"))
    return boxes.withColumns(sides).join(known, same, "left").withColumn("component", F.coalesce("__least", "id")).select(*boxes.columns, "component")
