"""Sharding by a hierarchical weighted hash tree: region, rack, shard. DataFrame functions only.

At each level the children of the chosen node race: child c with weight w draws -ln(u)/w, u a uniform hash of
(key, path of c), and the smallest draw wins. A child wins with probability w / (sum of weights), and raising one
child's weight only lowers that child's draw, so rows move only into the subtree whose weight rose (or out of the one
whose weight fell). Nothing is shuffled to place a row: the shard is a function of the key and the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.sources.scratch import written


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(n_shards: int, planned: int = 24, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Equal leaves. Shards below `planned` fill racks and regions in order; each later shard opens a region of its own,
    so that growth by one shard raises one region's weight and that region holds nothing but the new shard."""
    per_region = shards_per_rack * racks_per_region
    regions = -(-planned // per_region)
    return [
        Leaf(i // per_region, i // shards_per_rack, i) if i < planned else Leaf(regions + i - planned, 10_000 + i, i)
        for i in range(n_shards)
    ]


def _uniform(key: Column, path: Column) -> Column:
    """In (0, 1), from the first 13 hex digits (52 bits) of an md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), path)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _race(key: Column, children: list[tuple[str, int, float]], parent: Column) -> Column:
    """Id of the child with the smallest weighted draw; the smaller id on a tie. children: (path, id, weight) of all
    parents; a path starts with its parent's id."""
    by_parent: dict[int, list] = {}
    for path, i, w in children:
        by_parent.setdefault(int(path.split("/")[0]), []).append(F.struct(F.lit(path).alias("path"), F.lit(i).alias("id"), F.lit(float(w)).alias("w")))
    table = F.create_map(*[x for p, c in sorted(by_parent.items()) for x in (F.lit(p), F.array(*c))])
    draw = lambda c: F.struct((-F.log(_uniform(key, c["path"])) / c["w"]).alias("draw"), c["id"].alias("id"))
    return F.array_min(F.transform(F.element_at(table, parent), draw))["id"]


def assign_shards(df: DataFrame, key: str, tree: list[Leaf], region="region", rack="rack", shard="shard") -> DataFrame:
    """df with the three levels of its place in the tree. Adds no shuffle.

    A null key counts as the empty string, so all null keys share a shard; equal keys always do. Leaves of weight 0 or less
    get nothing. Columns of df that bear an output name are replaced. An empty df gives an empty df.
    """
    tree = [x for x in tree if x.weight > 0]
    if not tree:
        raise ValueError("the tree has no leaf with a positive weight")
    of_region: dict[int, float] = {}
    of_rack: dict[tuple[int, int], float] = {}
    for x in tree:
        of_region[x.region] = of_region.get(x.region, 0.0) + x.weight
        of_rack[x.region, x.rack] = of_rack.get((x.region, x.rack), 0.0) + x.weight
    regions = [(f"0/region/{r}", r, w) for r, w in sorted(of_region.items())]
    racks = [(f"{r}/rack/{k}", k, w) for (r, k), w in sorted(of_rack.items())]
    shards = [(f"{x.rack}/shard/{x.shard}", x.shard, x.weight) for x in sorted(tree, key=lambda x: x.shard)]
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return (
        df.withColumn(region, _race(k, regions, F.lit(0)))
        .withColumn(rack, _race(k, racks, F.col(region)))
        .withColumn(shard, _race(k, shards, F.col(rack)))
    )


#: Copies of one row that are unfolded together.
COPIES = 4096


def with_slots(df: DataFrame, shard: str, key: str, slot: str = "slot") -> DataFrame:
    """df with gapless slots from 0 in each shard, in the order (bucket, all columns).

    A bucket is a hash of the key; a shard of n rows has about sqrt(n) buckets, each numbered by itself and shifted by the
    rows in the buckets before it, so no task gets a whole shard. Equal rows are counted before the shuffle and unfolded
    after it, COPIES at a time, by other tasks if there are more: a row repeated any number of times is one row while it
    moves. Columns must be orderable. An empty df gives an empty df.
    """
    cols = df.columns
    digits = F.substring(F.md5(F.concat(F.lit("slot|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 7)
    folded = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__m")).withColumn("__h", F.conv(digits, 16, 10).cast("long"))
    folded = written(folded, "slots")  # texts are read once
    n, shards, most = folded.agg(F.sum("__m"), F.count_distinct(shard), F.max("__m")).first()
    buckets = max(1, int(((n or 0) / max(1, shards)) ** 0.5))
    folded = folded.withColumn("__b", F.pmod("__h", F.lit(buckets)))
    per_bucket = folded.groupBy(shard, "__b").agg(F.sum("__m").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(shard, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__b").orderBy(*[F.col(c).asc_nulls_last() for c in cols if c != shard]).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("__at", F.coalesce(F.sum("__m").over(within), F.lit(0))).join(starts, [shard, "__b"])
    first, end = F.col("__start") + F.col("__at"), F.col("__start") + F.col("__at") + F.col("__m")
    runs = placed.select(*cols, end.alias("__end"), F.explode(F.sequence(first, end - 1, F.lit(COPIES).cast("long"))).alias("__first"))
    if (most or 0) > COPIES:
        runs = runs.repartition("__first", *cols)
    last = F.least(F.col("__first") + COPIES, "__end") - 1
    return runs.select(*cols, F.explode(F.sequence("__first", last)).alias(slot))
