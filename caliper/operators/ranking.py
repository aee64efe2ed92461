"""Ranking of unlabeled items for annotation: percentile entropy by run, a quota of each cluster, group cover.

Every item lies in one group, so choosing a group never changes what another covers: the greedy weighted cover is the top
of one aggregate, and its running totals are a window over the chosen groups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliper.functions.stats import quota, running
from caliper.operators.ordered import with_percentile_rank


def normalized(runs: DataFrame, score: str = "mean_entropy") -> DataFrame:
    """runs (run_id, ...) with norm_entropy, the score's percentile rank within its run."""
    return with_percentile_rank(runs, ["run_id"], score, "norm_entropy")


def priority(rows: DataFrame, key: str, budget: float) -> DataFrame:
    """(key) of the highest norm_entropy of each (run_id, cluster), as many as the cluster's quota, all runs together.

    No quota exceeds the budget, so each task keeps only that many rows of a cluster before the shuffle.
    """
    in_cluster = Window.partitionBy("run_id", "cluster").orderBy(F.desc("norm_entropy"), key)
    top = rows.withColumn("__at", F.row_number().over(in_cluster)).where(F.col("__at") <= max(1, math.ceil(budget)))
    sizes = rows.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("__n"))
    totals = sizes.groupBy("run_id").agg(F.sum("__n").alias("__total"))
    quotas = sizes.join(totals, "run_id").select("run_id", "cluster", quota(F.col("__n"), F.col("__total"), budget).alias("__quota"))
    return top.join(quotas, ["run_id", "cluster"]).where("__at <= __quota").select(key).distinct()


def group_scores(items: DataFrame, key: str, group: str, prior: DataFrame, alpha: float) -> DataFrame:
    """(group, n_all, n_priority, raw, score): raw is the sum of the priority items' scores, score is raw / n_all^alpha.
    items (key, group, score); items without a group and groups without priority items are no candidates."""
    marked = items.where(F.col(group) != "").join(prior.withColumn("__p", F.lit(True)), key, "left")
    p = F.col("__p")
    out = marked.groupBy(group).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(p.isNotNull()).alias("n_priority"), F.sum(F.when(p, F.col("score"))).alias("raw"))
    return out.where("n_priority > 0").withColumn("score", F.col("raw") / F.pow("n_all", F.lit(float(alpha))))


def cover(scores: DataFrame, group: str, n_groups: int) -> DataFrame:
    """The n_groups best groups with group_rank and the running number of priority items covered; ties by group name."""
    best = scores.orderBy(F.desc(F.round("score", 9)), group).limit(n_groups)
    order = Window.orderBy(F.desc(F.round("score", 9)), group)  # over n_groups rows
    return best.withColumn("group_rank", F.row_number().over(order).cast("bigint")).withColumn("cumulative_priority_covered", running(F.sum("n_priority"), order))


def rank_for_annotation(runs: DataFrame, key: str, group: str, budget: float, n_groups: int, alpha: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, items of the chosen groups, all items) from runs (run_id, key, group, cluster, mean_entropy).

    An item's score is the least norm_entropy that any run gives it.
    """
    norm = normalized(runs)
    prior = priority(norm, key, budget)
    items = norm.groupBy(key, group).agg(F.min("norm_entropy").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set("cluster")), lambda c: c.cast("string")), ",").alias("clusters"))
    groups = cover(group_scores(items, key, group, prior, alpha), group, n_groups)
    tagged = items.join(prior.withColumn("is_priority", F.lit(True)), key, "left").fillna(False, ["is_priority"])
    chosen = tagged.join(groups.select(group, "group_rank"), group)
    return groups, chosen, tagged
