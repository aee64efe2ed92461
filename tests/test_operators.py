"""Properties and edge cases that the driver's tables do not hold."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caliper.functions import arrays as ar
from caliper.functions import geometry as geo
from caliper.functions import stats
from caliper.functions import strings as sx
from caliper.operators import ml
from caliper.operators import quality as qa
from caliper.operators import ranking as rk
from caliper.operators import relational as rel
from caliper.operators import splits as sp
from caliper.operators import summaries as sm
from caliper.operators.ordered import counts_before, nearest_quantiles, with_percentile_rank
from caliper.sources import readers as rd
from caliper.sources.scratch import scratch_path

NAN = float("nan")


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert rd.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="b"):
        rd.require_columns(df, ["a", "b"])


def test_nan_is_left_out_of_aggregates(spark):
    df = spark.createDataFrame([("a", NAN), ("a", 1.0), ("a", 2.0), ("a", None), ("b", NAN)], "k string, x double")
    got = {r["k"]: (r["mean"], r["max"], r["median"]) for r in sm.nan_summary(df, ["k"], "x").collect()}
    assert got == {"a": (1.5, 2.0, 1.5), "b": (None, None, None)}


def test_percent_error_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0), (1.0, None)], "e double, t double")
    assert [r[0] for r in df.select(stats.percent_error(F.col("e"), F.col("t"))).collect()] == [None, 25.0, None, None]


def test_log10_at_and_below_zero(spark):
    got = [r[0] for r in spark.sql("SELECT explode(array(100D, 0D, -0D, -1D, double('inf'), double('-inf'), double('nan'), NULL)) AS x").select(F.round(stats.log10(F.col("x")), 6)).collect()]
    assert got[:3] == [2.0, -math.inf, -math.inf] and got[4] == math.inf and got[7] is None
    assert all(math.isnan(got[i]) for i in (3, 5, 6))


def test_is_finite(spark):
    df = spark.createDataFrame([(NAN,), (math.inf,), (-math.inf,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(rd.is_finite(F.col("x"))).collect()] == [False, False, False, True, None]


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 2.0), ("r", 3.0)], "run string, x double")
    assert sorted(r["p"] for r in with_percentile_rank(df, ["run"], "x", "p").collect()) == [0.25, 0.625, 0.625, 1.0]


def test_nearest_quantile_half_even(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "x double")
    df = df.withColumn("k", F.lit("a"))
    q = nearest_quantiles(df, ["k"], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}).first()
    assert tuple(q)[1:] == (1.0, 2.0, 3.0, 4.0)
    assert nearest_quantiles(df.where("x > 9"), ["k"], "x", {"a": 0.5}).count() == 0


@pytest.mark.parametrize("ranges", [2, 5, 64])
def test_counts_before_are_exact(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice("ab"), rng.choice([0.0, 1.0, rng.random()])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, x double")
    for r in counts_before(df, ["k"], "x", ranges).collect():
        assert r["n"] == sum(k == r["k"] and x == r["x"] for k, x in rows)
        assert r["before"] == sum(k == r["k"] and x < r["x"] for k, x in rows)


def test_quota_rounds_half_to_even_and_is_one_at_least(spark):
    df = spark.createDataFrame([(5, 100.0, 50.0), (3, 100.0, 50.0), (0, 100.0, 50.0)], "n long, total double, b double")
    assert [r[0] for r in df.select(stats.quota(F.col("n"), F.col("total"), 50.0)).collect()] == [2, 2, 1]


points = st.lists(st.floats(-512, 512, width=32), min_size=8, max_size=8)


@settings(max_examples=25, deadline=None)
@given(p=points, g=points)
def test_matched_ends_cost_no_more_than_either_order(spark, p, g):
    df = spark.createDataFrame([(p, g)], "p array<double>, g array<double>").select("p", "g", geo.match_ends(F.col("p"), F.col("g"), 0).alias("m"))
    p, g, m = df.first()
    cost = lambda a, b, c, d: math.dist(a, c) + math.dist(b, d)
    straight = cost(p[0:2], p[2:4], g[0:2], g[2:4])
    crossed = cost(p[2:4], p[0:2], g[0:2], g[2:4])
    assert cost(m[0:2], m[2:4], g[0:2], g[2:4]) <= min(straight, crossed) + 1e-9


def test_affine_round_trips(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-1024, 1024) for _ in range(8)],) for _ in range(50)]
    df = spark.createDataFrame(rows, "p array<double>")
    flip = geo.horizontal_flip(640)
    m = geo.compose(geo.rotation(33, 4, 9), geo.crop_resize(F.lit(3.0), F.lit(5.0), F.lit(70.0), F.lit(90.0), 256.0))
    twice = geo.apply_affine(flip, geo.apply_affine(flip, F.col("p")))
    back = geo.apply_affine(geo.invert(m), geo.apply_affine(m, F.col("p")))
    cells = F.transform("p", lambda x: geo.from_heatmap(geo.to_heatmap(x, 4.0), 4.0))
    for r in df.select("p", twice, back, cells).collect():
        for other in r[1:]:
            assert all(abs(a - b) < 1e-7 for a, b in zip(r[0], other, strict=True))


def test_scale_validity(spark):
    df = spark.createDataFrame([(10.0, True), (0.0, True), (1e-6, True), (NAN, True), (math.inf, True), (10.0, False)], "s double, f boolean")
    assert [r[0] for r in df.select(geo.valid_scale(F.col("s"), F.col("f"))).collect()] == [True, False, False, False, False, False]


@pytest.mark.parametrize(("policy", "one_out", "both_out"), [("any", 0.0, 0.0), ("all", 1.0, 0.0), ("supervise", 1.0, 1.0)])
def test_bounds_policy(spark, policy, one_out, both_out):
    df = spark.createDataFrame([([1.0, 1.0, 2.0, 2.0],), ([1.0, 1.0, 10.0, 2.0],), ([-1.0, 1.0, 10.0, 2.0],)], "p array<double>")
    assert [r[0] for r in df.select(geo.bounds_mask(F.col("p"), 0, 10, 10, policy, F.lit(1.0))).collect()] == [1.0, one_out, both_out]


def test_uniform_logits_have_the_largest_entropy(spark):
    df = spark.createDataFrame([([0.0] * 64,), ([0.0] * 63 + [50.0],)], "e array<double>")
    got = df.select(geo.entropy(geo.softmax(F.col("e"))).alias("h"), geo.hard_argmax(F.col("e"), 8)).collect()
    assert abs(got[0][0] - math.log(64)) < 1e-9 and got[1][0] < 1e-9 and list(got[1][1]) == [7, 7]


def test_polyline_edges(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, 2.0, 3.0],), ([],), (None,)], "p array<double>")
    assert [r[0] for r in df.select(ar.rebased(F.col("p"), F.lit(1.0), F.lit(2.0))).collect()] == [[0.0, 0.0, 2.0, 2.0], None, None, None]
    assert [r[0] for r in df.select(ar.to_points(F.col("p"), F.lit(0.0), F.lit(0.0))).collect()][:3] == [[[1.0, 2.0], [3.0, 4.0]], [[1.0, 2.0]], []]
    five = spark.createDataFrame([([-5.0, 0.0],), ([-6.0, 0.0],), ([105.0, 0.0],)], "p array<double>")
    assert [r[0] for r in five.select(ar.in_bounds(F.col("p"), F.lit(100.0), F.lit(100.0), 5.0)).collect()] == [True, False, True]


def test_strings(spark):
    df = spark.createDataFrame([("a.b (12).jpg", "img/x/y.png", "né/w n.z", "g_1_x")], "a string, b string, c string, d string")
    got = df.select(sx.clean_file_name(F.col("a")), sx.directory(F.col("b")), sx.safe_file_name(F.col("c")), sx.trailing_int(F.col("d")), sx.strip_prefix(F.col("b"), "img."), sx.replace_first(F.col("a"), "[.]", "_")).first()
    assert tuple(got) == ("a.b.png", "img/x", "né_w_n.z", None, "img/x/y.png", "a_b (12).jpg")


def test_runs_with_other_keys_do_not_align(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k long, x double")
    b = spark.createDataFrame([(2, 0.1), (1, 0.2)], "k long, x double")
    assert {tuple(r) for r in rel.align_runs([a, b], "k").collect()} == {(1, 0.5, 0.2), (2, 0.6, 0.1)}
    with pytest.raises(ValueError, match="run 1"):
        rel.align_runs([a, b.where("k = 1")], "k")


def test_first_existing_path(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "c").mkdir()
    paths = [str(tmp_path / x) for x in "abc"]
    assert rd.first_existing(spark, paths) == paths[1] and rd.first_existing(spark, [f"file://{paths[2]}"]) == f"file://{paths[2]}"
    with pytest.raises(ValueError, match="none of these"):
        rd.first_existing(spark, paths[:1])


def test_absent_keeps_null_keys(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert sorted((r[0] for r in rel.absent(a, a.where("k = 1"), {"k": "k"}).collect()), key=str) == [2, None]


def test_merged_boxes_are_transitive(spark):
    rows = [("i", 1, 0.0, 2.0, 0.0, 1.0), ("i", 2, 1.0, 4.0, 0.0, 1.0), ("i", 3, 3.5, 6.0, 0.0, 1.0), ("i", 4, 9.0, 9.5, 0.0, 1.0), ("j", 1, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "image string, id long, x0 double, x1 double, y0 double, y1 double")
    got = {(r["image"], r["id"]): r["component"] for r in rel.merge_boxes(df, "image", 1.5).collect()}
    assert got == {("i", 1): 1, ("i", 2): 1, ("i", 3): 1, ("i", 4): 4, ("j", 1): 1}


def test_cover_equals_the_greedy_loop(spark):
    rng = random.Random(11)
    items = [(i, f"g{rng.randrange(12)}" if rng.random() < 0.9 else "", round(rng.random(), 3)) for i in range(150)]
    prior = {i for i, _, _ in items if rng.random() < 0.4}
    df = spark.createDataFrame(items, "id long, grp string, score double")
    scores = rk.group_scores(df, "id", "grp", spark.createDataFrame([(i,) for i in prior], "id long"), 1.0)
    got = [(r["grp"], r["group_rank"], r["cumulative_priority_covered"]) for r in rk.cover(scores, "grp", 6).orderBy("group_rank").collect()]
    left, covered, want = set(prior), 0, []
    while len(want) < 6 and left:
        gain = {}
        for i, g, s in items:
            if g and i in left:
                gain[g] = gain.get(g, 0) + s
        size = {g: sum(1 for _, h, _ in items if h == g) for g in gain}
        if not gain:
            break
        best = min(gain, key=lambda g: (-round(gain[g] / size[g], 9), g))
        taken = {i for i, g, _ in items if g == best and i in left}
        left -= taken
        covered += len(taken)
        want.append((best, len(want) + 1, covered))
    assert got == want


def test_prefix_split_takes_both_minima(spark):
    groups = [("a", f"g{i}", 3) for i in range(10)] + [("b", "h0", 100), ("b", "h1", 1), ("b", "h2", 1)]
    df = spark.createDataFrame(groups, "taxon string, grp string, n long")
    val = sp.prefix_split(df, "taxon", "grp", "n", 2, 10, 1).where("split = 'val'").groupBy("taxon").agg(F.count("*"), F.sum("n")).collect()
    by = {r[0]: (r[1], r[2]) for r in val}
    assert by["a"] == (4, 12) and by["b"][0] >= 2


def test_trusted_measurements(spark):
    rows = [("both", 1, "length", "t"), ("both", 2, "width", "t"), ("both", 0, "length", "x"), ("wid", 1, "width", "t"), ("wid", 0, "width", "x"), ("wid", 2, "length", "x"), ("none", 2, "length", "x"), ("none", 1, "length", "y")]
    df = spark.createDataFrame(rows, "id string, n long, kind string, who string")
    got = {(r["id"], r["kind"]): r["who"] for r in qa.trusted_measurements(df, "id", "kind", "who", "t", "n").collect()}
    assert got == {("both", "length"): "t", ("both", "width"): "t", ("wid", "width"): "t", ("wid", "length"): "x", ("none", "length"): "y"}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert sm.nan_summary(df, ["k"], "x").count() == 0
    assert sm.box_summary(df, ["k"], "x").count() == 0
    with pytest.raises(ValueError):
        qa.require_rows(df, "table")


def test_keyed_json_and_history(spark, tmp_path):
    f = tmp_path / "doc.json"
    f.write_text('{"a.png": {"w": 3}, "b.png": {"w": null}}')
    assert {tuple(r) for r in rd.read_keyed_json(spark, str(f), "struct<w:int>").collect()} == {("a.png", 3), ("b.png", None)}
    logged = spark.createDataFrame([(1, 0.5, NAN, "x"), (2, None, 1.0, "y")], "step long, `val/loss` double, lr double, note string")
    assert {tuple(r) for r in rd.history_rows(logged, ["step"]).collect()} == {(1, "val_loss", 0.5), (2, "lr", 1.0)}


def test_sinks_do_not_overwrite(spark):
    from caliper.sources import sinks as sk

    path = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, [1.5, 2.0])], "k long, xs array<double>")
    sk.write_csv(sk.lists_as_text(df), path, one_file=True)
    assert tuple(rd.read_csv(spark, path, "k long, xs string").first()) == (1, "1.5,2.0")
    with pytest.raises(Exception, match="(?i)exists"):
        sk.write_csv(sk.lists_as_text(df), path)


def test_stream_leaves_out_late_rows_and_equals_batch(spark, tmp_path):
    from caliper.streaming.history import latest_into, sessions, windowed_history

    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 3.0), ("2024-01-01 00:01:05", "b", 5.0)]
    df = spark.createDataFrame(rows, "t string, kind string, x double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    latest_into(windowed_history(stream, "ts", "kind", "x", "1 minute", "1 minute"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["kind"], r["n"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["kind"], r["n"], r["mean"]) for r in windowed_history(df, "ts", "kind", "x", "1 minute", "1 minute").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}
    assert {(r["kind"], r["n"]) for r in sessions(df, "ts", "kind", "30 seconds", "1 minute").collect()} == {("a", 1), ("b", 1)}


def test_key_problems_of_null_keys_in_one_pass(spark):
    from caliper.operators import ingest

    keyed = lambda rows: spark.createDataFrame(rows, f"{ingest.KEYS[0]} string, {ingest.KEYS[1]} long")
    found = ingest.key_problems(keyed([("a", 1), ("a", 1), ("b", 1), ("n", None)]), keyed([("a", 1), ("c", 1), ("c", 1), ("n", None), ("n", None)]))
    want = [("trait_duplicates", "a", 1, 2), ("traits_without_images", "b", 1, 1), ("traits_without_images", "n", None, 1)]
    want += [("image_duplicates", "c", 1, 2), ("images_without_traits", "c", 1, 1), ("image_duplicates", "n", None, 2), ("images_without_traits", "n", None, 1)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_annotation_documents_hold_a_trait_row_once_in_the_aggregate(spark):
    from caliper.operators import ingest

    keys = [f"'o1' AS {ingest.KEYS[0]}", f"1L AS {ingest.KEYS[1]}"]
    one = spark.range(1)
    traits = spark.range(2).selectExpr(*keys, *[f"array(array(double(id), 0, 2, 3)) AS {c}" for c in ingest.TRAITS])
    docs = ingest.annotation_documents(traits, one.selectExpr(*keys), one.selectExpr(*keys, "1 AS origin_x", "0 AS origin_y"))
    assert [m["polyline_px"][0] for m in docs.first()["measurements"]] == [-1.0] * 4
    assert "min_by" not in docs._jdf.queryExecution().executedPlan().toString()  # which holds value and order


def test_ingest_from_csv_to_documents(spark, tmp_path):
    from caliper.operators import ingest
    from caliper.sources.readers import read_csv
    from caliper.sources.sinks import write_json_lines

    (tmp_path / "traits.csv").write_text(
        "groupImageFilePath,BeetlePosition,individualID,coords_scalebar,coords_elytra_max_length,coords_basal_pronotum_width,coords_elytra_max_width\n"
        'group_images/IMG_01.png,1,a,"[[0, 0, 10, 0]]","[[15, 25, 35, 45], [1, 2, 3]]",[],not json\n'
        'group_images/IMG_01.png,2,b,,"[[12, 22, 14, 26, 18, 30]]",,"[[11]]"\n'
        'group_images/IMG_01.png,2,b,,"[[12, 22, 14, 26, 18, 30]]",,"[[11]]"\n'
        'group_images/img_02.png,7,c,"[[1, 1, 2, 2]]",,,\n'
    )
    (tmp_path / "images.csv").write_text(
        "individualImageFilePath,groupImageFilePath,individualID\n"
        "Individual/IMG_01_specimen_1.png,group_images/IMG_01.png,a\nindividual/img_01_specimen_2.png,group_images/img_01.png,b\n"
        "individual/img_01_specimen_3.png,group_images/img_01.png,x\nindividual/img_01_nothing.png,group_images/img_01.png,y\n"
    )
    texts = ", ".join(f"{c} string" for c in ingest.TRAITS)
    read = lambda name, schema: spark.read.csv(str(tmp_path / name), header=True, schema=schema, escape='"')
    traits = ingest.keyed_traits(read("traits.csv", f"groupImageFilePath string, BeetlePosition bigint, individualID string, {texts}"))
    images = ingest.keyed_images(read_csv(spark, str(tmp_path / "images.csv"), "individualImageFilePath string, groupImageFilePath string, individualID string"))
    problems = {tuple(r) for r in ingest.key_problems(traits, images).collect()}
    assert problems == {
        ("trait_duplicates", "img_01", 2, 2), ("images_without_traits", "img_01", 3, 1), ("images_without_traits", "img_01", None, 1), ("traits_without_images", "img_02", 7, 1),
    }
    origins = spark.createDataFrame([("img_01", 1, 10, 20), ("img_01", 2, 10, 20)], "group_img_basename string, beetle_position long, origin_x long, origin_y long")
    docs = ingest.annotation_documents(traits, images, origins)
    got = {r["individualID"]: [(m["measurement_type"], m["polyline_px"]) for m in r["measurements"]] for r in docs.collect()}
    assert got == {"a": [("scalebar", [-10.0, -20.0, 0.0, -20.0]), ("elytra_max_length", [5.0, 5.0, 25.0, 25.0])], "b": [("elytra_max_length", [2.0, 2.0, 4.0, 6.0, 8.0, 10.0])]}
    write_json_lines(docs, str(tmp_path / "annotations"))
    assert spark.read.json(str(tmp_path / "annotations")).count() == 2
    assert ingest.annotation_documents(traits.limit(0), images, origins).count() == 0


@pytest.mark.parametrize("held", [0, 1000])
def test_quantiles_and_places_of_null_groups(spark, monkeypatch, held):
    """held: rows of a group that an aggregate may hold; ranges beyond."""
    from caliper.operators import ordered
    from caliper.operators.ordered import interpolated_quantiles, placed_within, running_ema

    monkeypatch.setattr(ordered, "GROUP_ROWS", held)
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), (None, 5.0), (None, 9.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("id", F.monotonically_increasing_id())
    assert {tuple(r) for r in interpolated_quantiles(df, ["k"], "x", {"m": 0.5, "q": 0.75}).collect()} == {("a", 2.0, 3.0), (None, 7.0, 8.0)}
    assert [tuple(r) for r in interpolated_quantiles(df, [], "x", {"m": 0.5}).collect()] == [(4.0,)]
    placed = placed_within(df, ["k"], [F.col("x").desc(), F.col("id")], "place", "of")
    assert {(r["k"], r["x"], r["place"], r["of"]) for r in placed.collect()} == {("a", 4.0, 1, 3), ("a", 2.0, 2, 3), ("a", 1.0, 3, 3), (None, 9.0, 1, 2), (None, 5.0, 2, 2), ("b", None, 1, 1)}
    assert placed_within(df.limit(0), ["k"], [F.col("id")], "place").count() == 0
    ema = {(r["k"], r["step"]): r["ema"] for r in running_ema(df, "k", "id", "x", 0.5).collect()}
    assert ema[("a", 3)] == 2.75 and ema[(None, 2)] == 7.0 and len(ema) == 6
    assert interpolated_quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).count() == 0


def test_places_over_many_ranges(spark):
    df = spark.range(20_000).selectExpr("id", "id % 3 = 0 as g", "(id * 7919) % 10007 as x")
    from caliper.operators.ordered import placed_within

    got = placed_within(df.repartition(9), ["g"], [F.col("x"), F.col("id").desc()], "n").orderBy("g", "n").collect()
    for g in (False, True):
        own = [r for r in got if r["g"] == g]
        assert [r["n"] for r in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda r: (r["x"], -r["id"]))


def test_point_errors_and_losses_against_numpy(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(40):
        p, g, maps, targets = rng.normal(0, 10, 8), rng.normal(0, 10, 8), rng.normal(0, 1, (4, 9)), rng.random((4, 9))
        rows.append((i, p.tolist(), g.tolist(), *maps.tolist(), *targets.tolist(), float(i % 3 > 0), float(i % 4 > 0), None if i % 5 == 0 else 2.0))
    names = [f"p{c}" for c in range(4)] + [f"g{c}" for c in range(4)]
    df = spark.createDataFrame(rows, "id int, p array<double>, g array<double>, " + ", ".join(f"{c} array<double>" for c in names) + ", m0 double, m1 double, scale double")
    col = lambda a: [F.col(f"{a}{c}") for c in range(4)]
    masks = [F.col("m0"), F.col("m1")]
    got = df.select(
        "id",
        geo.point_error_cm(F.col("p"), F.col("g"), 1, F.col("scale"), (F.col("m0"), F.col("m1"))).alias("err"),
        geo.masked_line_loss(col("p"), col("g"), masks, geo.cross_entropy).alias("ce"),
        geo.masked_line_loss(col("p"), col("g"), masks, geo.squared_error, 18.0).alias("mse"),
    ).collect()
    for r, row in zip(sorted(got, key=lambda r: r["id"]), rows, strict=True):
        p, g = np.array(row[1]).reshape(4, 2)[2:], np.array(row[2]).reshape(4, 2)[2:]
        maps, targets, mask, scale = np.array(row[3:7]), np.array(row[7:11]), np.array(row[11:13]), row[13]
        straight, crossed = np.linalg.norm(p - g, axis=1), np.linalg.norm(p[::-1] - g, axis=1)
        best = crossed if crossed.sum() < straight.sum() else straight
        want = best[mask > 0].mean() / scale if scale and mask.any() else None
        assert (r["err"] is None) == (want is None) and (want is None or abs(r["err"] - want) < 1e-9)
        logp = maps - np.log(np.exp(maps).sum(axis=1, keepdims=True))
        share = targets / targets.sum(axis=1, keepdims=True)
        for name, loss, terms in (("ce", lambda a, b: -(share[b] * logp[a]).sum(), 1), ("mse", lambda a, b: ((maps[a] - targets[b]) ** 2).sum(), 18)):
            lines = np.array([min(loss(i, i) + loss(i + 1, i + 1), loss(i, i + 1) + loss(i + 1, i)) for i in (0, 2)])
            assert abs(r[name] - (lines * mask).sum() / max(mask.sum() * terms, 1e-8)) < 1e-9


@pytest.mark.parametrize("k", [3])
def test_kmeans_is_the_cheapest_fit(spark, k):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(3 * (i % 5), 1, 4).tolist()) for i in range(200)], "id int, v array<double>")
    rows = ml.kmeans_labels(df, "v", k, F.col("id"), n_init=5).collect()
    cost = 0.0
    for c in {r["cluster"] for r in rows}:
        own = np.array([r["v"] for r in rows if r["cluster"] == c])
        cost += ((own - own.mean(axis=0)) ** 2).sum()
    ready = df.withColumn("f", array_to_vector("v"))
    single = [KMeans(k=k, seed=42 + i, featuresCol="f").fit(ready).summary.trainingCost for i in range(5)]
    assert len(rows) == 200 and len({r["cluster"] for r in rows}) == k and cost <= min(single) * (1 + 1e-6)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, [5, 3, 1, 0.5], (150, 4)) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    c = x - x.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    got = np.array([[r["pc1"], r["pc2"]] for r in ml.pca_2d(df, "v").orderBy("id").collect()])
    shared = ml.shared_pca(df.where("id < 50"), df.where("id >= 50"), "v").orderBy("id").collect()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert np.allclose(np.abs([[r["pc1"], r["pc2"]] for r in shared]), np.abs(want), atol=1e-6) and sum(r["origin"] == "labeled" for r in shared) == 50


def test_scopes_drop_what_is_not_kept(spark):
    from caliper.sources.scratch import scope, written

    with scope():
        with scope() as kept:
            a, b = written(spark.range(5), "kept"), written(spark.range(6), "dropped")
            kept.append(a.where("id > 1").join(a, "id"))
        assert a.count() == 5
        with pytest.raises(Exception, match="(?i)not.*exist|no such"):
            b.count()
        with pytest.raises(ZeroDivisionError), scope():
            c = written(spark.range(7), "failed")
            1 / 0  # noqa: B018
        with pytest.raises(Exception, match="(?i)not.*exist|no such"):
            c.count()
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        a.count()
