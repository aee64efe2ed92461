"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every document of a source wants the same number of copies, target / source size: a whole part that it gets, and a
fractional part p that is rounded. Two documents with p and p' and sizes s and s' move mass between them, p*s + p'*s'
unchanged, until one of them is 0 or 1; the direction is drawn so that neither expectation changes. The settled one leaves,
the other is paired again. Blocks of about `fan` documents of one source are folded this way in parallel, their residuals
are blocks of the next level, and so on up a reduction tree, until a source has one residual left. Words taken from a
source then miss its target by less than that one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.sources.scratch import written

FAN = 256
EPS = 1e-9
_UNIT = "struct<tie:bigint,id:bigint,s:double,p:double>"
_OUT = "array<struct<id:bigint,extra:double>>"


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size): by code point, nulls last, weights repeat; together the targets
    are `share` of all sizes, none above `cap` times its source's size, the excess reshared by weight (water filling).

    One row per source goes through a single window: sources are few by their nature; rows never do.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cyc = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", cyc).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    per = per.withColumn("level", (whole - capped) / free)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())["level"]
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level, F.col("cap") / F.col("w")) * F.col("w")).alias("target"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(seed: int, *cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(2**53))


def _settle(out: Column, unit: Column, extra: Column) -> Column:
    return F.array_append(out, F.struct(unit["id"].alias("id"), extra.alias("extra")))


def _state(unit: Column, p: Column, out: Column) -> Column:
    return F.struct(unit["id"].alias("id"), unit["tie"].alias("tie"), unit["s"].alias("s"), p.alias("p"), out.alias("out"))


def _pivot(seed: int):
    """One step of the fold: the carrier and the next unit exchange mass until one is integral."""

    def step(acc: Column, x: Column) -> Column:
        moves = F.struct(
            F.least((1 - acc["p"]) * acc["s"], x["p"] * x["s"]).alias("up"),
            F.least(acc["p"] * acc["s"], (1 - x["p"]) * x["s"]).alias("down"),
            _uniform(seed, acc["tie"], x["tie"]).alias("u"),
        )

        def exchange(m: Column) -> Column:
            d = F.when(m["u"] * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])
            after = F.struct((acc["p"] + d / acc["s"]).alias("a"), (x["p"] - d / x["s"]).alias("b"))
            return _let(
                after,
                lambda q: F.when((q["a"] <= EPS) | (q["a"] >= 1 - EPS), _state(x, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q["b"])), _settle(acc["out"], acc, F.rint(q["a"])))).otherwise(
                    _state(acc, q["a"], _settle(acc["out"], x, F.rint(q["b"])))
                ),
            )

        whole = (acc["p"] <= EPS) | (acc["p"] >= 1 - EPS)
        return (
            F.when(acc["id"].isNull(), _state(x, x["p"], acc["out"]))
            .when(whole, _state(x, x["p"], _settle(acc["out"], acc, F.rint(acc["p"]))))
            .otherwise(_let(moves, exchange))
        )

    return step


def _fold(units: DataFrame, seed: int) -> DataFrame:
    """One row per (source, block): the settled units and the residual."""
    empty = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("tie"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("p"), F.array().cast(_OUT).alias("out"))
    packed = units.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("tie", "id", "s", "p").cast(_UNIT))).alias("units"))
    return packed.select("source", "block", F.aggregate("units", empty, _pivot(seed)).alias("r"))


def copies(units: DataFrame, targets: DataFrame, seed: int = 17, fan: int = FAN, cut: bool = False) -> DataFrame:
    """(source, id, copies double) for units (source, id bigint, size) with size > 0 and unique (source, id).

    cut: the one residual of each source keeps its fraction (its last copy is cut at words); else it is drawn like the rest.
    """
    want = F.try_divide(F.col("target"), F.col("source_size"))
    t = targets.where("source_size > 0").select(F.col("source").alias("__src"), F.floor(want + EPS).cast("double").alias("base"), F.greatest(F.lit(0.0), want - F.floor(want + EPS)).alias("p"))
    counted = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max("n")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, most), fan)))
    t = t.join(counted.withColumnRenamed("source", "__src2"), F.col("__src").eqNullSafe(F.col("__src2"))).drop("__src2")
    tie = F.xxhash64(F.lit(seed), "source", "id")
    level = units.join(F.broadcast(t) if few_sources(t) else t, units["source"].eqNullSafe(t["__src"])).select(
        "source", "id", F.col("size").cast("double").alias("s"), "p", "n", tie.alias("tie")
    )
    settled = []
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(fan)))).cast("long")
    level = level.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "tie"), blocks))
    for i in range(levels + 1):
        last = i == levels
        if last:  # one block a source
            level = level.withColumn("block", F.lit(0).cast("long"))
        folded = written(_fold(level, seed + i), "mix-folded")
        settled.append(folded.select("source", F.explode("r.out").alias("o")).select("source", F.col("o.id").alias("id"), F.col("o.extra").alias("extra")))
        rest = folded.where("r.id is not null").select("source", "block", "r.*")
        if last:
            drawn = F.when(_uniform(seed - 1, F.col("tie")) < F.col("p"), 1.0).otherwise(0.0)
            settled.append(rest.select("source", "id", (F.col("p") if cut else drawn).alias("extra")))
        else:
            level = rest.select("source", "id", "s", "p", "tie", F.floor(F.col("block") / F.lit(fan)).alias("block"))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.join(t.select("__src", "base"), out["source"].eqNullSafe(F.col("__src"))).select("source", "id", (F.col("base") + F.col("extra")).alias("copies"))


def few_sources(t: DataFrame, limit: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast."""
    return t.limit(limit + 1).count() <= limit


def mix(docs: DataFrame, size: Column, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, cut: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each row of docs.

    Rows with equal (doc_id, source) are one unit and get equal copies; null ids and null sources are values like others.
    Size 0 gets copies 0. Extra columns of docs are ignored. Empty docs give no rows. Reruns agree: every draw is a hash.
    """
    sizes = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.cast("long").alias("size"))
    sizes = written(sizes.hint("rebalance"), "mix-sizes")  # few files: a row is a hundredth of its text
    targets = source_targets(sizes, list(weights), share, cap)
    targets = written(targets, "mix-targets")
    units = sizes.where("size > 0").groupBy("source", F.col("doc_id").alias("id")).agg(F.sum("size").alias("size"))
    c = copies(units.withColumn("id", F.coalesce("id", F.lit(-(2**63)))), targets, seed, cut=cut).select(F.col("source").alias("__s"), F.col("id").alias("__i"), "copies")
    t = targets.select(F.col("source").alias("__t"), "source_size", "target")
    out = sizes.join(c, sizes["source"].eqNullSafe(F.col("__s")) & (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("__i")), "left")
    out = out.join(t, out["source"].eqNullSafe(F.col("__t")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, F.col("copies")), F.lit(0.0)).alias("copies"))
