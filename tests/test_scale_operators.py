"""Operators that settle loops, recurrences and pairs without one task that holds a group, against the plain loops."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliper.operators import ordered
from caliper.operators import relational
from caliper.operators import splits as sp
from caliper.operators.ordered import running_ema
from caliper.operators.relational import pairs_within
from caliper.operators.summaries import density


def order(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest(), key


def loop_split(pairs, least_groups, least_items, seed):
    by = defaultdict(list)
    for t, g, n in pairs:
        by[t].append((g, n))
    val = {g for gs in by.values() if len(gs) <= least_groups for g, _ in gs}
    for t in sorted((t for t in by if len(by[t]) > least_groups), key=lambda t: order(seed, t)):
        groups = items = 0
        for g, n in sorted((x for x in by[t] if x[0] not in val), key=lambda x: order(seed, x[0])):
            if groups >= least_groups and items >= least_items:
                break
            val.add(g)
            groups, items = groups + 1, items + n
    return val


def loop_one_group(pairs, seed):
    by = defaultdict(set)
    for t, g in pairs:
        by[t].add(g)
    out = {(t, next(iter(gs))) for t, gs in by.items() if len(gs) == 1}
    val = {g for _, g in out}
    for t in sorted((t for t in by if len(by[t]) > 1), key=lambda t: order(seed, t)):
        if not by[t] & val:
            g = min(by[t], key=lambda g: order(seed, g))
            val.add(g)
            out.add((t, g))
    return out


def cases(n):
    """n random inputs in one table: taxa and groups of different cases have different names."""
    rng, out = random.Random(11), []
    for c in range(n):
        taxa, groups = rng.randint(1, 9), rng.randint(1, 14)
        for t in range(taxa):
            for g in rng.sample(range(groups), rng.randint(1, groups)):
                out.append((f"{c}t{t}", f"{c}g{g}", rng.randint(1, 6)))
    return out


@pytest.mark.parametrize("residue", [0, 500, 100_000])
def test_sequential_split_equals_the_loop_on_1000_inputs(spark, monkeypatch, residue):
    """residue: pairs that one task may settle by the loop; 0: rounds alone."""
    monkeypatch.setattr(sp, "RESIDUE", residue)
    rows = cases(1000)
    df = spark.createDataFrame(rows, "taxon string, grp string, n long")
    got = sp.sequential_split(df, "taxon", "grp", "n", 2, 8, 5).collect()
    assert len(got) == len({g for _, g, _ in rows})
    assert {r["grp"] for r in got if r["split"] == "val"} == loop_split(rows, 2, 8, 5)


def test_one_group_equals_the_loop_on_1000_inputs(spark):
    rows = [(t, g) for t, g, _ in cases(1000)]
    got = sp.sequential_one_group(spark.createDataFrame(rows, "taxon string, grp string"), "taxon", "grp", 5).collect()
    assert {tuple(r) for r in got} == loop_one_group(rows, 5) and len(got) == len(set(map(tuple, got)))


def test_rounds_stay_few(spark):
    """20,000 taxa in a ring, each sharing a group with the next, and one group that all taxa have."""
    n = 20_000
    rows = [(t, g, 1) for t in range(n) for g in (t, (t + 1) % n, t + n, t + 2 * n, 5 * n)]
    pairs = spark.createDataFrame(rows, "taxon long, grp long, n long")
    start = sp._turns(pairs, "taxon", "grp", F.col("n"), 5).withColumn("__in", F.lit(None).cast("boolean"))
    taken, rounds = sp._settle(start, 2, 3, 0)
    assert {r["__g"] for r in taken.select("__g").distinct().collect()} == loop_split(rows, 2, 3, 5) and rounds <= 12


def test_splits_of_nothing_and_of_nulls(spark, monkeypatch):
    df = spark.createDataFrame([], "taxon string, grp string, n long")
    assert sp.sequential_split(df, "taxon", "grp", "n", 2, 8, 5).count() == 0 == sp.sequential_one_group(df, "taxon", "grp", 5).count()
    rows = [(None, "a", 1), (None, "b", 1), (None, None, 1), ("x", None, 2), ("x", "a", 1), ("y", None, 1), ("y", "a", 1), ("y", "c", 1), ("z", "c", 1), ("z", "d", 1), ("z", None, 1)]
    df = spark.createDataFrame(rows, "taxon string, grp string, n long")
    for residue in (0, 100):
        monkeypatch.setattr(sp, "RESIDUE", residue)
        val = {r["grp"] for r in sp.sequential_split(df, "taxon", "grp", "n", 1, 2, 5).where("split = 'val'").collect()}
        again = {r["grp"] for r in sp.sequential_split(df.repartition(7), "taxon", "grp", "n", 1, 2, 5).where("split = 'val'").collect()}
        assert val == again and len(val) >= 2
    assert {tuple(r) for r in sp.sequential_one_group(df, "taxon", "grp", 5).collect()} == loop_one_group([r[:2] for r in rows if None not in r], 5)


def plain_ema(values, beta):
    out, e = [], None
    for v in values:
        if v is not None and not math.isnan(v):
            e = v if e is None else beta * e + (1 - beta) * v
        out.append(e)
    return out


@pytest.mark.parametrize("beta", [0.9, 0.5, 0.999])
def test_ema_against_the_recurrence(spark, beta):
    rng = random.Random(3)
    rows, want = [], {}
    for run in ["a", "b", None, "long"]:
        values = [rng.choice([None, float("nan"), rng.gauss(0, 100), 10.0**rng.randint(-5, 12)]) for _ in range(30_000 if run == "long" else rng.randint(1, 60))]
        want |= {(run, i + 1): e for i, e in enumerate(plain_ema(values, beta))}
        rows += [(run, 7 * i, v) for i, v in enumerate(values)]
    rows += [("none", i, None) for i in range(5)]
    rng.shuffle(rows)
    out = running_ema(spark.createDataFrame(rows, "k string, i long, x double").repartition(8), "k", "i", "x", beta)
    got = {(r["k"], r["step"]): r["ema"] for r in out.collect()}
    assert all(got.pop(("none", i + 1)) is None for i in range(5)) and got.keys() == want.keys()
    for at, e in want.items():
        assert (e is None) == (got[at] is None) and (e is None or math.isclose(got[at], e, rel_tol=1e-10, abs_tol=1e-12)), at


def test_a_long_run_is_many_tasks_work(spark):
    """Two million steps of one run: no task of the last stage has more than a part, and no Python runs."""
    df = spark.range(2_000_000).selectExpr("1 as k", "id as i", "cast(id % 1000 as double) as x")
    out = running_ema(df, "k", "i", "x", 0.9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("InPandas|Python|SinglePartition", plan)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2_000_000 and max(sizes) < 1_500_000
    steady = plain_ema([float(i % 1000) for i in range(30_000)], 0.9)[-1]
    assert math.isclose(out.where("step = 2000000").first()["ema"], steady, rel_tol=1e-12)


@pytest.mark.parametrize("width", [0.7, 500.0])
def test_density_against_all_pairs(spark, width):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 40 * width, 900), "b": np.repeat(rng.normal(0, width, 30), 20), "c": np.array([1e6, -1e6, 0.0, width / 2])}
    rows = [(g, f"{g}{i}", float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("a", "none", None), (None, "lost", 1.0)]
    got = {r["k"]: r["density"] for r in density(spark.createDataFrame(rows, "g string, k string, x double"), "g", "k", "x", width).collect()}
    assert got["none"] is None and got["lost"] is None and len(got) == len(rows)
    for g, x in groups.items():
        want = np.exp(-(((x[:, None] - x) / width) ** 2) / 2).mean(axis=1) / (width * math.sqrt(2 * math.pi))
        assert max(abs(got[f"{g}{i}"] - v) for i, v in enumerate(want)) * width < 1e-12


def test_density_of_a_million_values_in_one_group(spark):
    df = spark.range(1_000_000).selectExpr("'g' as g", "id as k", "cast(id % 100000 as double) as x")
    out = density(df, "g", "k", "x", 50.0).where("x = 50000").first()["density"]
    assert math.isclose(out, 1e-5, rel_tol=1e-9)  # even values: one in 100,000 a unit


def near(a, b, tolerances):
    return any(x is not None and y is not None and abs(x - y) <= t for x, y, t in zip(a, b, tolerances, strict=True))


@pytest.mark.parametrize("tolerances", [(3.0, 0.5), (0.0, 0.1), (1e9, 0.0)])
def test_pairs_within_tolerances(spark, tolerances):
    rng = random.Random(6)
    value = lambda: rng.choice([None, float("nan"), rng.uniform(-40, 40), float(rng.randint(-9, 9)), 0.1 * rng.randint(-9, 9)])
    rows = [(rng.choice(["p", "q", None]), i, value(), value()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, top double, bottom double")
    got = [(r["g"], r["a"]["id"], r["b"]["id"]) for r in pairs_within(df, "g", "id", {"top": tolerances[0], "bottom": tolerances[1]}).collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1] and near(a[2:], b[2:], tolerances)}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_large_group_are_cheap(spark):
    """300,000 boxes of one image, of which only neighbours are near: a join by the group would meet 9e10 pairs."""
    df = spark.range(300_000).selectExpr("'image' as g", "id", "id * 10.0D as top")
    assert pairs_within(df, "g", "id", {"top": 10.0}).count() == 299_999


def test_rows_of_small_groups_are_shuffled_once_and_not_by_bands(spark, monkeypatch):
    rows = [(g, i, float(i % 7), float(i)) for g in range(40) for i in range(1 + g % 12)]
    df = spark.createDataFrame(rows, "g long, id long, top double, bottom double")
    found = pairs_within(df, "g", "id", {"top": 1, "bottom": 1})
    assert "collect_list" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["g"], r["a"]["id"], r["b"]["id"]) for r in found.collect())
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (abs(a[2] - b[2]) <= 1 or abs(a[3] - b[3]) <= 1))
    assert got == want
    for bound in (0, 5):  # all groups by bands, and some
        monkeypatch.setattr(relational, "GROUP_ROWS", bound)
        assert sorted((r["g"], r["a"]["id"], r["b"]["id"]) for r in pairs_within(df, "g", "id", {"top": 1, "bottom": 1}).collect()) == want


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_held_and_by_ranges_agree(spark, monkeypatch, keys):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 40)), rng.gauss(0, 9)])) for _ in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    cuts = {"lo": 0.0, "q": 0.3, "m": 0.5, "hi": 1.0}

    def found():
        a = ordered.interpolated_quantiles(df, keys, "x", cuts)
        b = ordered.nearest_quantiles(df, keys, "x", cuts)
        c = ordered.with_quantiles(df, keys, "x", {"m": 0.5}, [F.sum("n").alias("n"), ordered.weighted_mean("x").alias("mean")])
        round_ = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        empty = [f(df.limit(0), keys, "x", cuts).count() for f in (ordered.interpolated_quantiles, ordered.nearest_quantiles)]
        return [sorted(map(round_, x.collect()), key=str) for x in (a, b, c)], empty

    held = found()
    monkeypatch.setattr(ordered, "GROUP_ROWS", 10)
    ranged = found()
    assert held == ranged and held[1] == [0, 0]
    values = sorted(x for g, x in rows if x is not None and (not keys or g == "a"))
    first = next(r for r in held[0][1] if not keys or r[0] == "a")
    assert first[-2] == pytest.approx(values[round(0.5 * (len(values) - 1))], abs=1e-9)


def test_a_taxon_brings_no_more_pairs_to_the_rounds_than_it_can_reach(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, g, rng.randint(1, 3)) for t in (1, 2, 3, None) for g in [None, *rng.sample(range(3000), 2000)]] + [(9, 5, 1)]
    df = spark.createDataFrame(rows, "t long, g long, n long")
    monkeypatch.setitem(globals(), "order", lambda seed, key, plain=order: ("", "") if key is None else plain(seed, key))  # NULL first
    settled, settle = [], sp._settle
    monkeypatch.setattr(sp, "_settle", lambda pairs, *a: (settled.append(pairs.count()), settle(pairs, *a))[1])
    got = {r["g"] for r in sp.sequential_split(df, "t", "g", "n", 2, 5, 3).where("split = 'val'").collect()}
    assert got == loop_split(rows, 2, 5, 3)
    assert settled[0] <= 4 * 4 * 22  # 4 taxa, 22 groups that all can bring, of 8,000 pairs


def test_first_groups_are_found_without_digests_of_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    rows = sorted({(rng.randrange(40), rng.randrange(300)) for _ in range(1500)})
    wide, written = [], sp.written
    monkeypatch.setattr(sp, "written", lambda df, name: (wide.append(df.columns) if df.count() >= len(rows) else None, written(df, name))[1])
    got = {tuple(r) for r in sp.sequential_one_group(spark.createDataFrame(rows, "t long, g long"), "t", "g", 3).collect()}
    assert got == loop_one_group(rows, 3)
    assert wide == [["__t", "__g"]]


def _plain_components(boxes):
    parent = {(b[0], b[1]): (b[0], b[1]) for b in boxes}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]:
                u, v = sorted((root((a[0], a[1])), root((b[0], b[1]))))
                parent[v] = u
    return {k: root(k)[1] for k in parent}


def test_boxes_in_halved_cells_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_BOXES", 6)
    rng = random.Random(5)
    kinds = [
        lambda: (rng.uniform(-9, 9), rng.uniform(0, 1.5), rng.uniform(-9, 9), rng.uniform(0, 1.5)),
        lambda: (rng.randint(-6, 6), rng.randint(0, 1), rng.randint(-6, 6), rng.randint(0, 1)),  # on the borders of cells
        lambda: (1.0, 0.0, rng.uniform(0, 40), rng.uniform(0, 0.9)),  # a line of segments
        lambda: (rng.uniform(0, 4), 4.0, rng.uniform(0, 4), 4.0),  # a pile
        lambda: (rng.uniform(0, 30), 0.01, 0.0, 20.0) if rng.random() < 0.5 else (0.0, 30.0, rng.uniform(0, 20), 0.01),  # a lattice
        lambda: (rng.choice((0.0, 5.0)), 1.0, 0.0, 1.0),  # copies
    ]
    boxes = []
    for image, kind in enumerate(kinds):
        ids = rng.sample(range(1000), 50)
        for i in ids:
            x, w, y, h = kind()
            boxes.append((image, i, float(x), float(x + w), float(y), float(y + h)))
    df = spark.createDataFrame(boxes, "image int, id long, x0 double, x1 double, y0 double, y1 double")
    got = {(r["image"], r["id"]): r["component"] for r in relational.merge_boxes(df, "image", 3.0).collect()}
    assert got == _plain_components(boxes)


def test_a_pile_of_boxes_costs_links_in_proportion(spark):
    at = lambda seed: (F.rand(seed) * 4).alias("x")
    n = 4000
    pile = spark.range(n).select(F.lit(0).alias("image"), "id", at(1), at(2).alias("y")).selectExpr("image", "id", "x AS x0", "x + 4 AS x1", "y AS y0", "y + 4 AS y1").localCheckpoint()
    assert relational._box_links(pile, 4.0).count() < 20 * n  # 8 million pairs
    assert [tuple(r) for r in relational.merge_boxes(pile, "image", 4.0).groupBy("component").count().collect()] == [(0, n)]
