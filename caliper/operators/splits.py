"""Group-aware train/validation splits. Shuffles are md5 orders, equal on every engine and cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.functions.stats import running, seeded_order
from caliper.operators.ordered import placed_within
from caliper.operators.relational import absent
from caliper.operators.skew import join_hot
from caliper.sources.scratch import drop, written


def prefix_split(groups: DataFrame, taxon: str, group: str, n: str, least_groups: int, least_items: int, seed: int) -> DataFrame:
    """groups (taxon, group, n) with `split`: of each taxon's shuffled groups those are validation that come before both
    least_groups groups and least_items items have been taken. Taxa are split independently of one another."""
    order = Window.partitionBy(taxon).orderBy(seeded_order(F.col(group), seed), group)
    before = F.coalesce(running(F.sum(n), order, including=False), F.lit(0))
    taken = (F.row_number().over(order) - 1 < least_groups) | (before < least_items)
    return groups.withColumn("split", F.when(taken, "val").otherwise("train"))


def one_group_per_taxon(rows: DataFrame, taxon: str, group: str, forced: DataFrame, seed: int) -> DataFrame:
    """(taxon, group): the first shuffled group of each taxon that has none among the forced groups."""
    pairs = rows.select(taxon, group).distinct()
    covered = pairs.join(forced.select(group).distinct(), group, "left_semi")
    open_ = absent(pairs, covered, {taxon: taxon})
    order = Window.partitionBy(taxon).orderBy(seeded_order(F.col(group), seed), group)
    return open_.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _first_of(cond: Column) -> Column:
    """Aggregate: the earliest taxon of the loop for which cond holds."""
    return F.min(F.when(cond, F.col("__turn")))


def _known(pairs: DataFrame, least_groups: int, least_items: int) -> DataFrame:
    """pairs with `__sure` and `__maybe`: whether the taxon brings the group to validation at the latest when its turn is over,
    and whether it may. `__in` says that the group is in validation before the taxon's turn, NULL that this is not known."""
    order = Window.partitionBy("__t").orderBy("__place", "__g")
    free, open_ = F.coalesce(~F.col("__in"), F.lit(False)), F.coalesce(~F.col("__in"), F.lit(True))

    def reached(counts: Column) -> Column:
        before = lambda x: F.coalesce(running(F.sum(F.when(counts, x).otherwise(0)), order, including=False), F.lit(0))
        return open_ & ~((before(F.lit(1)) >= least_groups) & (before(F.col("__n")) >= least_items))

    return pairs.withColumns({"__sure": reached(open_), "__maybe": reached(free)})


#: Pairs of unsettled taxa that one task may settle by the loop itself.
RESIDUE = 100_000


def _loop(least_groups: int, least_items: int):
    """From rows (__t, __g, __n, __in) in the order of the loop, those that bring their group to validation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        val, taxon, groups, items = set(), object(), 0, 0
        for f in frames:
            out = []
            for t, g, n, known in zip(f["__t"], f["__g"], f["__n"], f["__in"], strict=True):
                t, g = (None if pd.isna(x) else x for x in (t, g))
                if t != taxon:
                    taxon, groups, items = t, 0, 0
                if (groups < least_groups or items < least_items) and (known is False or known == 0 or g not in val):
                    val.add(g)
                    groups, items = groups + 1, items + n
                    out.append(g)
            yield pd.DataFrame({"__g": pd.Series(out, dtype=f["__g"].dtype if len(out) and not any(x is None for x in out) else object)})

    return run


def _settle(pairs: DataFrame, least_groups: int, least_items: int, residue: int | None = None) -> tuple[DataFrame, int]:
    """(__g) of the pairs (__t, __g, __n, __turn, __place, __in) that bring a group to validation, and the rounds this took. Once
    the taxa that are not settled have at most `residue` pairs left, one task settles them in turn."""
    rounds, residue = 0, RESIDUE if residue is None else residue
    pairs = pairs.withColumn("__g", F.struct(F.col("__g").alias("g")))  # in which NULL equals NULL
    plain = F.col("__g.g").alias("__g")

    def settled(left: DataFrame) -> DataFrame:
        turns = left.repartition(1).sortWithinPartitions("__turn", "__place", "__g").select("__t", plain, "__n", "__in")
        return turns.mapInPandas(_loop(least_groups, least_items), turns.select("__g").schema)

    if pairs.count() <= residue:
        return settled(pairs), rounds
    while True:
        rounds += 1
        known = written(_known(pairs, least_groups, least_items), "split-round")
        open_ = known.where("__in is null and __maybe").select(F.struct("__t").alias("__k")).distinct()
        if open_.isEmpty():
            return known.where("__sure").select(plain), rounds
        firsts = known.groupBy("__g").agg(_first_of(F.col("__sure")).alias("__first_sure"), _first_of(F.col("__maybe")).alias("__first_maybe"))
        met = join_hot(known.drop("__sure", "__maybe"), firsts, "__g")
        in_ = F.when(F.col("__first_sure") < F.col("__turn"), True).when(F.coalesce(F.col("__first_maybe") >= F.col("__turn"), F.lit(True)), False)
        after = written(met.withColumn("__in", in_).drop("__first_sure", "__first_maybe"), "split-round")
        left = after.where("not coalesce(__in, false)").withColumn("__k", F.struct("__t")).join(open_, "__k", "left_semi").drop("__k")
        if left.count() <= residue:  # what is open in it depends on taxa in it alone
            return known.where("__sure").select(plain).union(settled(left)), rounds
        drop(known)
        pairs = after


def _turns(pairs: DataFrame, taxon: str, group: str, n: Column, seed: int) -> DataFrame:
    """(__t, __g, __n, __turn, __place): the loop takes taxa in the order of __turn, a taxon its groups in that of __place."""
    turn = F.struct(seeded_order(F.col(taxon), seed).alias("order"), F.col(taxon).alias("taxon"))
    return pairs.select(F.col(taxon).alias("__t"), F.col(group).alias("__g"), n.alias("__n"), turn.alias("__turn"), seeded_order(F.col(group), seed).alias("__place"))


def _seeded_number(key: Column, seed: int) -> Column:
    """The leading 60 bits of seeded_order, which order keys as it does but for a tie."""
    return F.conv(F.substring(seeded_order(key, seed), 1, 15), 16, 10).cast("long")


def _reachable(pairs: DataFrame, sizes: DataFrame, limit: int, seed: int) -> DataFrame:
    """The pairs (__t, __g, ..) among which are each taxon's first `limit` shuffled groups, not many more than twice as many;
    sizes (__t, __groups). Counts of the lengths of the groups' numbers say how long a number of the first ones may be."""
    long_ = sizes.where(F.col("__groups") > limit)
    if long_.isEmpty():
        return pairs
    bits = pairs.withColumn("__bits", F.coalesce(F.length(F.bin(_seeded_number(F.col("__g"), seed))), F.lit(0)))  # NULL comes first
    counts = bits.groupBy("__t", "__bits").agg(F.count(F.lit(1)).alias("__c"))
    upto = counts.withColumn("__upto", running(F.sum("__c"), Window.partitionBy("__t").orderBy("__bits")))
    cuts = upto.groupBy(F.struct("__t").alias("__k")).agg(F.min(F.when(F.col("__upto") >= limit, F.col("__bits"))).alias("__most"))
    met = bits.withColumn("__k", F.struct("__t")).join(F.broadcast(cuts.where("__most is not null")), "__k", "left")
    return met.where("__most is null or __bits <= __most").select(*pairs.columns)


def sequential_split(pairs: DataFrame, taxon: str, group: str, n: str, least_groups: int, least_items: int, seed: int) -> DataFrame:
    """(group, split) of pairs (taxon, group, n >= 1), unique by taxon and group, where taxa share groups.

    Groups of taxa with least_groups groups at most are validation. The other taxa, in a seeded order, each take their shuffled
    groups that are not yet validation, until they have taken both least_groups groups and least_items items.

    The loop is settled in rounds. A pair is `sure` if the taxon's turn leaves the group in validation whatever its unsettled
    neighbours do, `maybe` if it could: the prefix that the taxon takes is shortest if it gets all unsettled groups, longest
    if it gets none. What earlier taxa surely bring is out of reach of later ones, what none of them may bring is free. Each
    round is a window by taxon and an aggregate by group; the earliest unsettled taxon is settled in every round, and in a
    random order most are; the last RESIDUE pairs are one task's. NULL taxa and groups are values like others.

    All taxa together bring a bounded number of groups to validation. A taxon passes over no more than these, so that its
    groups after as many take no part and leave before the rounds."""
    narrow = written(pairs.select(F.col(taxon).alias("__t"), F.col(group).alias("__g"), F.col(n).alias("__n")), "split-pairs")
    many = written(narrow.groupBy("__t").agg(F.count(F.lit(1)).alias("__groups")), "split-taxa")
    reach = max(least_groups, least_items)  # more groups of its own no taxon takes
    small, taxa = many.agg(F.count_if(F.col("__groups") <= least_groups), F.count(F.lit(1))).first()
    placed = _turns(_reachable(narrow, many, least_groups * small + reach * (taxa - small), seed), "__t", "__g", F.col("__n"), seed)
    tagged = written(join_hot(written(placed.withColumn("__k", F.struct("__t")), "split-pairs"), many.select(F.struct("__t").alias("__k"), "__groups"), "__k").drop("__k"), "split-pairs")
    forced = tagged.where(F.col("__groups") <= least_groups).select("__g").distinct()
    open_ = tagged.where(F.col("__groups") > least_groups).drop("__groups")
    groups = open_.groupBy("__g").agg(F.count(F.lit(1)).alias("__taxa")).join(forced.select(F.col("__g").alias("__f")), F.col("__g").eqNullSafe(F.col("__f")), "left_anti")
    keyed = written(open_.withColumn("__k", F.struct("__g")), "split-open")
    both = join_hot(keyed, groups.select(F.struct("__g").alias("__k"), "__taxa"), "__k").drop("__k")
    own = Window.partitionBy("__t").orderBy("__place", "__g")
    alone = both.where("__taxa = 1").withColumn("__at", F.row_number().over(own)).where(F.col("__at") <= reach).drop("__at")
    start = alone.withColumn("__in", F.lit(False)).unionByName(both.where("__taxa > 1").withColumn("__in", F.lit(None).cast("boolean"))).drop("__taxa")
    taken, _ = _settle(written(start, "split-start"), least_groups, least_items)
    val = forced.union(taken).distinct().select(F.struct("__g").alias("__v"))
    all_ = narrow.select("__g").distinct().withColumn("__k", F.struct("__g"))
    split = F.when(F.col("__v").isNotNull(), "val").otherwise("train").alias("split")
    return all_.join(val, F.col("__k") == F.col("__v"), "left").select(F.col("__g").alias(group), split)


def sequential_one_group(pairs: DataFrame, taxon: str, group: str, seed: int) -> DataFrame:
    """(taxon, group): the groups that a loop over the taxa brings to validation, each with the taxon that brings it.

    Groups of taxa with one group are validation. Of the other taxa, in a seeded order, each that has no group in validation
    brings its first shuffled group. pairs (taxon, group) are unique; those with a NULL do not count. Settled in rounds like sequential_split: only a taxon's
    first group matters, and it waits for the earlier taxa whose first group it has."""
    narrow = written(pairs.where(F.col(taxon).isNotNull() & F.col(group).isNotNull()).select(F.col(taxon).alias("__t"), F.col(group).alias("__g")), "split-pairs")
    at = _seeded_number(F.col("__g"), seed)
    sizes = written(narrow.groupBy("__t").agg(F.count(F.lit(1)).alias("__groups"), F.min(at).alias("__least")), "split-taxa")
    near = _turns(join_hot(narrow, sizes, "__t").where(at == F.col("__least")), "__t", "__g", F.col("__groups"), seed)  # one pair a taxon, but for ties
    taxa = written(near.groupBy("__t").agg(F.first("__n").alias("__groups"), F.first("__turn").alias("__turn"), F.min_by("__g", F.struct("__place", "__g")).alias("__first")), "split-taxa")
    single = taxa.where("__groups = 1").select(F.col("__t").alias(taxon), F.col("__first").alias(group))
    forced = single.select(F.struct(F.col(group).alias("__g")).alias("__k")).distinct().withColumn("__forced", F.lit(True))
    many = taxa.where("__groups > 1").withColumn("__takes", F.lit(None).cast("boolean")).drop("__groups")
    firsts = many.select(F.struct(F.col("__first").alias("__g")).alias("__k")).distinct().join(forced, "__k", "full_outer")
    met = join_hot(narrow.withColumn("__k", F.struct("__g")), firsts, "__k")
    rivals = written(met.join(many.select("__t", "__turn"), "__t").select("__t", "__k", "__turn", "__forced"), "split-rivals")
    state = written(many, "split-state")
    while not state.where("__takes is null").isEmpty():
        by_first = state.groupBy(F.struct(F.col("__first").alias("__g")).alias("__k")).agg(_first_of(F.col("__takes")).alias("__first_sure"), _first_of(F.coalesce("__takes", F.lit(True))).alias("__first_maybe"))
        seen = rivals.join(by_first, "__k", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("__turn"), F.lit(False))
        in_ = F.coalesce("__forced", F.lit(False))
        told = seen.groupBy("__t").agg(F.bool_or(in_ | before("__first_sure")).alias("__covered"), F.bool_or(in_ | before("__first_maybe")).alias("__perhaps"))
        takes = F.when(F.col("__covered"), False).when(~F.col("__perhaps"), True)
        after = written(state.drop("__takes").join(told, "__t").withColumn("__takes", takes).drop("__covered", "__perhaps"), "split-state")
        drop(state)
        state = after
    return single.unionByName(state.where("__takes").select(F.col("__t").alias(taxon), F.col("__first").alias(group)))


def tail_split(df: DataFrame, part: list[str], key: str, fraction: float) -> DataFrame:
    """df with `split`: within each part the last max(1, round(n * fraction)) keys, half to even, are validation."""
    placed = placed_within(df, part, [F.col(key)], "__at", "__n")
    held = F.greatest(F.lit(1), F.rint(F.col("__n") * F.lit(fraction)).cast("long"))
    return placed.withColumn("split", F.when(F.col("__at") > F.col("__n") - held, "val").otherwise("train")).drop("__at", "__n")


def split_report(groups: DataFrame, taxon: str, n: str) -> DataFrame:
    """(taxon, groups, items, val_groups, val_items, kind, val_pct) of groups (taxon, n, split)."""
    val = F.col("split") == "val"
    out = groups.groupBy(taxon).agg(F.count(F.lit(1)).alias("groups"), F.sum(n).alias("items"), F.count_if(val).alias("val_groups"), F.coalesce(F.sum(F.when(val, F.col(n))), F.lit(0)).alias("val_items"))
    kind = F.when(F.col("val_groups") == F.col("groups"), "ALL VAL").otherwise("MIXED")
    return out.withColumn("kind", kind).withColumn("val_pct", F.try_divide(F.col("val_items").cast("double"), "items") * 100)


def below_threshold(report: DataFrame, groups: int, items: int) -> Column:
    return (report["val_groups"] < groups) | (report["val_items"] < items)
