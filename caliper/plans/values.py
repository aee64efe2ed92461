"""Strings, lists, JSON text, arithmetic, geometry, heatmaps, models (X*, J-*, L-*, M-*, G*, V1-V3, V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caliper.functions import arrays as ar
from caliper.functions import geometry as geo
from caliper.functions import stats as st
from caliper.functions import strings as sx
from caliper.operators import ml
from caliper.operators import quality as qa
from caliper.plans.basics import r6
from caliper.plans.catalog import query


@query("X1_first_token", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS genus FROM orders")
def x1(t):
    return t.orders.select("o_orderkey", sx.first_token(F.col("o_orderpriority"), "-").alias("genus"))


@query("X2_last_segment", "SELECT page_id, string_split(url, '/')[-1] AS seg FROM pages")
def x2(t):
    return t.pages.select("page_id", sx.last_segment(F.col("url")).alias("seg"))


@query("X3_strip_prefix_suffix", "SELECT page_id, regexp_replace(regexp_replace(url, '^https://', ''), '\\.html$', '') AS s FROM pages")
def x3(t):
    return t.pages.select("page_id", sx.strip_suffix(sx.strip_prefix(F.col("url"), "https://"), ".html").alias("s"))


@query("X4_lowercase", "SELECT p_partkey, lower(p_brand) AS brand FROM part")
def x4(t):
    return t.part.select("p_partkey", F.lower("p_brand").alias("brand"))


@query("X5_extract_int", "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/(\\d+)\\.html$', 1), '') AS BIGINT) AS number FROM pages")
def x5(t):
    return t.pages.select("page_id", sx.extract_int(F.col("url"), r"/(\d+)\.html$").alias("number"))


@query("X6_replace_first", "SELECT page_id, regexp_replace(url, 'e.', '__') AS s FROM pages")
def x6(t):
    return t.pages.select("page_id", sx.replace_first(F.col("url"), "e.", "__").alias("s"))


@query("X7_starred_label", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN '* ' || c_mktsegment ELSE c_mktsegment END AS label FROM customer")
def x7(t):
    return t.customer.select("c_custkey", sx.starred(F.col("c_mktsegment"), ["BUILDING", "AUTOMOBILE"]).alias("label"))


@query("X8_joined_ints", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts, min(l_partkey) AS first_part FROM lineitem GROUP BY 1")
def x8(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(sx.joined_ints(F.sort_array(F.collect_list("l_partkey"))).alias("parts"))
    return lists.withColumn("first_part", sx.first_int(F.col("parts")))


@query("X9_clean_file_name", "SELECT c_custkey, 'img_' || c_custkey || '.png' AS f FROM customer")
def x9(t):
    name = F.concat(F.lit("img_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " (3).jpg").otherwise(".jpg"))
    return t.customer.select("c_custkey", sx.clean_file_name(name).alias("f"))


@query("X10_safe_file_name", "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g') AS f FROM pages")
def x10(t):
    return t.pages.select("page_id", sx.safe_file_name(F.col("url")).alias("f"))


@query("X11_trailing_int", "SELECT s_suppkey, s_suppkey * 2 AS n FROM supplier")
def x11(t):
    return t.supplier.select("s_suppkey", sx.trailing_int(F.concat(F.lit("group_a_"), (F.col("s_suppkey") * 2).cast("string"))).alias("n"))


@query("X12_value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'unknown' END AS s FROM orders")
def x12(t):
    names = t.spark.createDataFrame([("F", "final"), ("O", "open")], "o_orderstatus string, s string")
    return t.orders.join(F.broadcast(names), "o_orderstatus", "left").select("o_orderkey", F.coalesce("s", F.lit("unknown")).alias("s"))


@query("X13_structure_name", "SELECT p_partkey, replace(lower('Elytra' || p_type), 'elytra', 'elytra_') AS s FROM part")
def x13(t):
    return t.part.select("p_partkey", sx.snake_structure(F.concat(F.lit("Elytra"), F.col("p_type"))).alias("s"))


@query("X14_path_rebuild", "SELECT page_id, regexp_replace(url, '/[^/]*$', '') || '/thumb/' || page_id || '.png' AS p FROM pages")
def x14(t):
    return t.pages.select("page_id", F.concat(sx.directory(F.col("url")), F.lit("/thumb/"), F.col("page_id").cast("string"), F.lit(".png")).alias("p"))


@query("X15_directory_choice", "SELECT page_id, CASE WHEN contains(url, 'blog') THEN 'blogs' ELSE 'sites' END AS d FROM pages")
def x15(t):
    return t.pages.select("page_id", F.when(F.contains("url", F.lit("blog")), "blogs").otherwise("sites").alias("d"))


K = "TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)"


@query("J-1_json_nested_list", f"SELECT event_id, {K}::DOUBLE AS a, ({K} + 1)::DOUBLE AS b, 2::BIGINT AS n FROM events")
def j_1(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    text = F.concat(F.lit("[["), k.cast("string"), F.lit(".0],["), (k + 1).cast("string"), F.lit(".0]]"))
    return t.events.select("event_id", F.from_json(text, "array<array<double>>").alias("p")).select("event_id", F.col("p")[0][0].alias("a"), F.col("p")[1][0].alias("b"), F.size("p").cast("bigint").alias("n"))


@query("J-2_quoted_struct", f"SELECT event_id, CASE WHEN event_id % 10 > 0 THEN {K} END AS x1 FROM events")
def j_2(t):
    text = F.when(F.col("event_id") % 10 > 0, F.replace(F.replace("props", F.lit('"k"'), F.lit('""x1""')), F.lit("}"), F.lit(", 'y1': 2}"))).otherwise("broken {")
    return t.events.select("event_id", sx.quoted_struct(text, "x1 bigint, y1 bigint")["x1"].alias("x1"))


@query("J-3_int_tuple", "SELECT s_suppkey, s_suppkey AS h, s_nationkey::BIGINT AS w FROM supplier")
def j_3(t):
    text = F.concat(F.lit("("), F.col("s_suppkey").cast("string"), F.lit(", "), F.col("s_nationkey").cast("string"), F.lit(")"))
    return t.supplier.select("s_suppkey", sx.int_tuple(text).alias("d")).select("s_suppkey", F.col("d")[0].alias("h"), F.col("d")[1].alias("w"))


E4 = "embedding[1:4]::DOUBLE[]"


@query("L-1_list_ends_sum_join", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS head, round(embedding[64]::DOUBLE, 6) AS last, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def l_1(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", r6(F.get(e, F.lit(0))).alias("head"), r6(F.element_at(e, -1)).alias("last"), r6(ar.total(e)).alias("total"))


@query("L-2_list_length", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def l_2(t):
    return t.conversations.groupBy("conv_id").agg(F.size(F.collect_list("turn")).cast("bigint").alias("n"))


@query("L-3_points_from_flat", "SELECT vec_id, i, round(embedding[2 * i + 1]::DOUBLE - 10, 6) AS x, round(embedding[2 * i + 2]::DOUBLE - 20, 6) AS y FROM embeddings, (SELECT unnest(range(32)) AS i)")
def l_3(t):
    e = F.col("embedding").cast("array<double>")
    pts = t.embeddings.select("vec_id", F.posexplode(ar.to_points(e, F.lit(10.0), F.lit(20.0))).alias("i", "p"))
    return pts.select("vec_id", F.col("i").cast("bigint").alias("i"), r6(F.col("p")[0]).alias("x"), r6(F.col("p")[1]).alias("y"))


@query("L-4_rebased_polyline", "SELECT vec_id, round(list_sum(embedding[1:4]::DOUBLE[]) - 2 * 3 - 2 * 5, 6) AS total FROM embeddings WHERE vec_id % 3 > 0")
def l_4(t):
    e = F.slice(F.col("embedding").cast("array<double>"), F.lit(1), F.when(F.col("vec_id") % 3 == 0, 3).otherwise(4))
    return t.embeddings.select("vec_id", ar.rebased(e, F.lit(3.0), F.lit(5.0)).alias("p")).where("p is not null").select("vec_id", r6(ar.total(F.col("p"))).alias("total"))


@query("L-5_polyline_ends", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[64]::DOUBLE, 6) AS y1 FROM embeddings")
def l_5(t):
    ends = ar.ends(ar.to_points(F.col("embedding").cast("array<double>"), F.lit(0.0), F.lit(0.0)))
    return t.embeddings.select("vec_id", ends.alias("e")).select("vec_id", r6(F.col("e")[0]).alias("x0"), r6(F.col("e")[3]).alias("y1"))


@query("L-6_bounds_with_tolerance", f"SELECT vec_id, list_bool_and([x BETWEEN -0.25 AND 0.35 FOR x IN {E4}]) AS ok FROM embeddings")
def l_6(t):
    p = F.slice(F.col("embedding").cast("array<double>"), 1, 4)
    return t.embeddings.select("vec_id", ar.in_bounds(p, F.lit(0.1), F.lit(0.1), 0.25).alias("ok"))


@query("L-7_bounds_exact", f"SELECT vec_id, list_bool_and([x BETWEEN 0 AND 0.3 FOR x IN {E4}]) AS ok FROM embeddings")
def l_7(t):
    p = F.slice(F.col("embedding").cast("array<double>"), 1, 4)
    return t.embeddings.select("vec_id", ar.in_bounds(p, F.lit(0.3), F.lit(0.3), 0.0).alias("ok"))


@query("L-8_drop_invalid_elements", "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity <= 40) AS kept, count(*) FILTER (WHERE l_quantity > 40) > 0 AS changed FROM lineitem GROUP BY 1")
def l_8(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("m"))
    cleaned, changed = qa.drop_invalid_elements(nested, "m", lambda m: m["l_quantity"] <= 40)
    flags = changed.select("l_orderkey", F.lit(True).alias("changed"))
    return cleaned.join(flags, "l_orderkey", "left").select("l_orderkey", F.size("m").cast("bigint").alias("kept"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query("M-1_arithmetic", "SELECT event_id, round(abs(value - 100), 6) AS a, round(log10(value), 6) AS l, round(pow(value, 0.5::DOUBLE), 6) AS p FROM events")
def m_1(t):
    v = F.col("value")
    return t.events.select("event_id", r6(F.abs(v - 100)).alias("a"), r6(st.log10(v)).alias("l"), r6(F.pow(v, F.lit(0.5))).alias("p"))


@query("M-2_half_even", "SELECT o_orderkey, round_even(o_totalprice / 3, 4) AS r FROM orders")
def m_2(t):
    return t.orders.select("o_orderkey", F.bround(F.col("o_totalprice") / 3, 4).alias("r"))


def pts(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.transform(F.slice(e, 1, 8), lambda x: x * 100).alias("p"), F.transform(F.slice(e, 9, 8), lambda x: x * 100).alias("g"), F.slice(e, 17, 4).alias("bar"), e.alias("e"))


P_SQL = "p AS (SELECT vec_id, [x * 100 FOR x IN embedding[1:8]::DOUBLE[]] AS p, [x * 100 FOR x IN embedding[9:16]::DOUBLE[]] AS g, embedding[17:20]::DOUBLE[] AS bar, embedding::DOUBLE[] AS e FROM embeddings)"


def affine():
    return geo.array_of(2, 0.5, 3, -1, 1.5, 4)


def xy(c, i):
    return r6(F.col(c)[i])


@query("G1_apply_affine", f"WITH {P_SQL} SELECT vec_id, round(2 * p[1] + 0.5 * p[2] + 3, 6) AS x, round(-p[7] + 1.5 * p[8] + 4, 6) AS y FROM p")
def g1(t):
    return pts(t).select("vec_id", geo.apply_affine(affine(), F.col("p")).alias("q")).select("vec_id", xy("q", 0).alias("x"), xy("q", 7).alias("y"))


@query("G2_affine_builders", f"WITH {P_SQL} SELECT vec_id, round((p[1] - 10) * 256 / 50::DOUBLE, 6) AS crop_x, round(255 - p[1], 6) AS flip_x, round(199 - p[2], 6) AS flip_y, round(cos(radians(30)) * (p[1] - 5) - sin(radians(30)) * (p[2] - 7) + 5, 6) AS rot_x FROM p")
def g2(t):
    p = F.col("p")
    crop = geo.crop_resize(F.lit(10.0), F.lit(20.0), F.lit(50.0), F.lit(40.0), 256.0)
    done = pts(t).select("vec_id", geo.apply_affine(crop, p)[0].alias("a"), geo.apply_affine(geo.horizontal_flip(256), p)[0].alias("b"), geo.apply_affine(geo.vertical_flip(200), p)[1].alias("c"), geo.apply_affine(geo.rotation(30, 5, 7), p)[0].alias("d"))
    return done.select("vec_id", r6("a").alias("crop_x"), r6("b").alias("flip_x"), r6("c").alias("flip_y"), r6("d").alias("rot_x"))


@query("G3_compose_invert", f"WITH {P_SQL} SELECT vec_id, round(p[1], 6) AS x, round(p[2], 6) AS y FROM p")
def g3(t):
    m = geo.compose(geo.horizontal_flip(256), affine())
    back = geo.apply_affine(geo.invert(m), geo.apply_affine(m, F.col("p")))
    return pts(t).select("vec_id", back.alias("q")).select("vec_id", xy("q", 0).alias("x"), xy("q", 1).alias("y"))


def d_sql(a, i, b, j):
    return f"sqrt(pow({a}[{2 * i + 1}] - {b}[{2 * j + 1}], 2) + pow({a}[{2 * i + 2}] - {b}[{2 * j + 2}], 2))"


SWAP = f"({d_sql('p', 1, 'g', 0)} + {d_sql('p', 0, 'g', 1)} < {d_sql('p', 0, 'g', 0)} + {d_sql('p', 1, 'g', 1)})"


@query("G4_match_ends", f"WITH {P_SQL} SELECT vec_id, round(CASE WHEN {SWAP} THEN p[3] ELSE p[1] END, 6) AS x0, round(CASE WHEN {SWAP} THEN p[2] ELSE p[4] END, 6) AS y1 FROM p")
def g4(t):
    return pts(t).select("vec_id", geo.match_ends(F.col("p"), F.col("g"), 0).alias("m")).select("vec_id", xy("m", 0).alias("x0"), xy("m", 3).alias("y1"))


@query("G5_valid_scale", f"WITH {P_SQL} SELECT vec_id, round({d_sql('bar', 0, 'bar', 1)}, 6) AS px_per_cm, {d_sql('bar', 0, 'bar', 1)} > 1e-6 AND vec_id % 4 > 0 AS valid FROM p")
def g5(t):
    s = geo.px_per_cm(F.col("bar"))
    return pts(t).select("vec_id", r6(s).alias("px_per_cm"), geo.valid_scale(s, F.col("vec_id") % 4 > 0).alias("valid"))


@query("G6_length_error_cm", f"WITH {P_SQL} SELECT vec_id, round(CASE WHEN vec_id % 4 > 0 THEN abs({d_sql('p', 2, 'p', 3)} - {d_sql('g', 2, 'g', 3)}) / {d_sql('bar', 0, 'bar', 1)} END, 6) AS err FROM p")
def g6(t):
    mask = (F.col("vec_id") % 4 > 0).cast("double")
    return pts(t).select("vec_id", r6(geo.length_error_cm(F.col("p"), F.col("g"), 1, geo.px_per_cm(F.col("bar")), mask)).alias("err"))


def ends_sql(line):
    """Distances of the two matched ends of a line."""
    i, j = 2 * line, 2 * line + 1
    straight, crossed = f"({d_sql('p', i, 'g', i)} + {d_sql('p', j, 'g', j)})", f"({d_sql('p', j, 'g', i)} + {d_sql('p', i, 'g', j)})"
    either = lambda a, b: f"CASE WHEN {crossed} < {straight} THEN {b} ELSE {a} END"
    return either(d_sql("p", i, "g", i), d_sql("p", j, "g", i)), either(d_sql("p", j, "g", j), d_sql("p", i, "g", j))


def masked_mean_sql(line, first, second):
    a, b = ends_sql(line)
    return f"round(list_avg(list_filter([CASE WHEN {first} THEN {a} END, CASE WHEN {second} THEN {b} END], lambda x: x IS NOT NULL)) / CASE WHEN s > 1e-6 AND vec_id % 4 > 0 THEN s END, 6)"


@query("G7_point_errors", f"WITH {P_SQL}, m AS (SELECT *, {d_sql('bar', 0, 'bar', 1)} AS s FROM p) SELECT vec_id, {masked_mean_sql(0, 'vec_id % 3 > 0', 'vec_id % 5 > 0')} AS width_err, {masked_mean_sql(1, 'true', 'vec_id % 3 > 0')} AS length_err FROM m")
def g7(t):
    scale = geo.px_per_cm(F.col("bar"))
    usable = F.when(geo.valid_scale(scale, F.col("vec_id") % 4 > 0), scale)
    third, fifth = ((F.col("vec_id") % k > 0).cast("double") for k in (3, 5))
    error = lambda line, *masks: r6(geo.point_error_cm(F.col("p"), F.col("g"), line, usable, masks))
    return pts(t).select("vec_id", error(0, third, fifth).alias("width_err"), error(1, F.lit(1.0), third).alias("length_err"))


OUT = " + ".join(f"(NOT (p[{2 * i + 1}] >= 0 AND p[{2 * i + 1}] < 20 AND p[{2 * i + 2}] >= 0 AND p[{2 * i + 2}] < 15))::INT" for i in range(4))


@query("G8_outside_fraction", f"WITH {P_SQL} SELECT vec_id, round(({OUT}) / 4.0::DOUBLE, 6) AS outside FROM p")
def g8(t):
    return pts(t).select("vec_id", r6(geo.outside_fraction(F.col("p"), 20, 15)).alias("outside"))


IN0, IN1 = ("(p[1] >= 0 AND p[1] < 20 AND p[2] >= 0 AND p[2] < 15)", "(p[3] >= 0 AND p[3] < 20 AND p[4] >= 0 AND p[4] < 15)")


@query("G9_bounds_policy", f"WITH {P_SQL} SELECT vec_id, ({IN0} AND {IN1})::INT::DOUBLE AS any_out, ({IN0} OR {IN1})::INT::DOUBLE AS all_out, 1.0::DOUBLE AS supervised FROM p")
def g9(t):
    m = lambda policy: geo.bounds_mask(F.col("p"), 0, 20, 15, policy, F.lit(1.0))
    return pts(t).select("vec_id", m("any").alias("any_out"), m("all").alias("all_out"), m("supervise").alias("supervised"))


@query("G10_heatmap_coordinates", f"WITH {P_SQL} SELECT vec_id, round((p[1] + 0.5) / 4 - 0.5, 6) AS h, round(p[1], 6) AS back FROM p")
def g10(t):
    h = geo.to_heatmap(F.col("p")[0], 4.0)
    return pts(t).select("vec_id", r6(h).alias("h"), r6(geo.from_heatmap(h, 4.0)).alias("back"))


@query("G11_gaussian_target", f"WITH {P_SQL} SELECT vec_id, round(list_sum([exp(-(pow(i % 8 - (3 + e[1]), 2) + pow(i // 8 - (4 + e[2]), 2)) / 2) FOR i IN range(64)]), 6) AS total FROM p")
def g11(t):
    g = geo.gaussian_map(3 + F.col("e")[0], 4 + F.col("e")[1], 8, 1.0)
    return pts(t).select("vec_id", r6(ar.total(g)).alias("total"))


@query("G12_soft_argmax", f"WITH {P_SQL} SELECT vec_id, round(list_sum([exp(e[i + 1]) * (i % 8) FOR i IN range(64)]) / list_sum([exp(x) FOR x IN e]), 6) AS x, round(list_sum([exp(e[i + 1]) * (i // 8) FOR i IN range(64)]) / list_sum([exp(x) FOR x IN e]), 6) AS y FROM p")
def g12(t):
    return pts(t).select("vec_id", geo.expected_cell(geo.softmax(F.col("e")), 8).alias("c")).select("vec_id", xy("c", 0).alias("x"), xy("c", 1).alias("y"))


@query("G13_entropy", f"WITH {P_SQL}, s AS (SELECT vec_id, e, list_sum([exp(x) FOR x IN e]) AS z FROM p) SELECT vec_id, round(-list_sum([exp(x) / z * ln(exp(x) / z) FOR x IN e]), 6) AS entropy, round(list_max(e), 6) AS max_logit, -list_sum([exp(x) / z * ln(exp(x) / z) FOR x IN e]) >= 0.98 * ln(64) AS near_uniform FROM s")
def g13(t):
    h = geo.entropy(geo.softmax(F.col("e")))
    return pts(t).select("vec_id", "e", h.alias("h")).select("vec_id", r6("h").alias("entropy"), r6(F.array_max("e")).alias("max_logit"), geo.near_uniform(F.col("h"), 64).alias("near_uniform"))


MAPS_SQL = f"""WITH {P_SQL}, maps AS (SELECT vec_id, (vec_id % 3 > 0)::INT::DOUBLE AS mw, (vec_id % 4 > 0)::INT::DOUBLE AS ml, [[e[16 * c + i + 1] FOR i IN range(16)] FOR c IN range(4)] AS pm,
    [[exp(-(pow(i % 4 - (1.5 + g[2 * c + 1] / 10), 2) + pow(i // 4 - (1.5 + g[2 * c + 2] / 10), 2)) / 2) FOR i IN range(16)] FOR c IN range(4)] AS gm FROM p),
    logs AS (SELECT vec_id, mw, ml, gm, pm, [[x - ln(list_sum([exp(y) FOR y IN m])) FOR x IN m] FOR m IN pm] AS lp FROM maps)"""


def line_loss_sql(loss, line):
    i, j = 2 * line + 1, 2 * line + 2
    return f"least({loss(i, i)} + {loss(j, j)}, {loss(i, j)} + {loss(j, i)})"


def loss_sql(loss, terms):
    return f"{MAPS_SQL} SELECT vec_id, round(({line_loss_sql(loss, 0)} * mw + {line_loss_sql(loss, 1)} * ml) / greatest((mw + ml) * {terms}, 1e-8::DOUBLE), 6) AS loss FROM logs"


def channels(t):
    """(vec_id, predicted map and target map of each of 4 line ends, masks of the 2 lines)."""
    e, g = F.col("e"), F.col("g")
    maps = [F.slice(e, 16 * c + 1, 16).alias(f"p{c}") for c in range(4)] + [geo.gaussian_map(1.5 + g[2 * c] / 10, 1.5 + g[2 * c + 1] / 10, 4, 1.0).alias(f"g{c}") for c in range(4)]
    masks = [(F.col("vec_id") % k > 0).cast("double").alias(f"m{k}") for k in (3, 4)]
    return pts(t).select("vec_id", *maps, *masks)


def ends(letter):
    return [F.col(f"{letter}{c}") for c in range(4)]


@query("G14_matched_cross_entropy", loss_sql(lambda i, j: f"(-list_sum([lp[{i}][k + 1] * gm[{j}][k + 1] FOR k IN range(16)]) / list_sum(gm[{j}]))", "1"))
def g14(t):
    return channels(t).select("vec_id", r6(geo.masked_line_loss(ends("p"), ends("g"), [F.col("m3"), F.col("m4")], geo.cross_entropy)).alias("loss"))


@query("G14_matched_squared_error", loss_sql(lambda i, j: f"list_sum([pow(pm[{i}][k + 1] - gm[{j}][k + 1], 2) FOR k IN range(16)])", "2 * 16"))
def g14_squared(t):
    return channels(t).select("vec_id", r6(geo.masked_line_loss(ends("p"), ends("g"), [F.col("m3"), F.col("m4")], geo.squared_error, 2.0 * 16)).alias("loss"))


@query("G14b_hard_argmax", f"WITH {P_SQL} SELECT vec_id, CAST((list_position(e, list_max(e)) - 1) % 8 AS BIGINT) AS x, CAST((list_position(e, list_max(e)) - 1) // 8 AS BIGINT) AS y FROM p")
def g14b(t):
    return pts(t).select("vec_id", geo.hard_argmax(F.col("e"), 8).alias("c")).select("vec_id", F.col("c")[0].cast("bigint").alias("x"), F.col("c")[1].cast("bigint").alias("y"))


@query("G15_crop_scale", f"WITH {P_SQL} SELECT vec_id, round(sqrt(pow((bar[1] - bar[3]) * 300 / 256::DOUBLE, 2) + pow((bar[2] - bar[4]) * 200 / 256::DOUBLE, 2)), 6) AS px_per_cm FROM p")
def g15(t):
    b = F.col("bar")
    x = lambda i: geo.crop_to_image(b[i], 256.0, F.lit(40.0), F.lit(300.0))
    y = lambda i: geo.crop_to_image(b[i], 256.0, F.lit(60.0), F.lit(200.0))
    return pts(t).select("vec_id", r6(geo.px_per_cm(F.array(x(0), y(1), x(2), y(3)))).alias("px_per_cm"))


@query("G16_normalised_end_error", f"WITH {P_SQL} SELECT vec_id, round({d_sql('p', 0, 'g', 0)} / greatest({d_sql('g', 0, 'g', 1)}, 1e-6), 6) AS err FROM p")
def g16(t):
    p, g = F.col("p"), F.col("g")
    return pts(t).select("vec_id", r6(geo.distance(p, 0, g, 0) / F.greatest(geo.line_length(g, 0), F.lit(1e-6))).alias("err"))


@query("G17_clip_coordinates", f"WITH {P_SQL} SELECT vec_id, round(p[1] - 3, 6) AS x, round(p[2] - 4, 6) AS y, NOT (p[1] - 3 >= 0 AND p[1] - 3 < 12 AND p[2] - 4 >= 0 AND p[2] - 4 < 9) AS outside FROM p")
def g17(t):
    x, y = F.col("p")[0] - 3.0, F.col("p")[1] - 4.0
    return pts(t).select("vec_id", r6(x).alias("x"), r6(y).alias("y"), (~geo.inside(x, y, 12, 9)).alias("outside"))


#: Five restarts of 73 centers, 20 steps, in integers; the labels of the cheapest.
def _kmeans_sql(k: int, restarts: int, steps: int) -> str:
    ctes = [
        f"""x AS MATERIALIZED (SELECT vec_id, v, list_dot_product(v, v) AS vv FROM (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 4096)) AS v FROM embeddings))""",
        f"""c0 AS MATERIALIZED (SELECT r, row_number() OVER (PARTITION BY r ORDER BY md5((42 + r) || '|' || vec_id), vec_id) - 1 AS j, v AS c FROM x, range({restarts}) t(r) QUALIFY j < {k})""",
    ]
    for s in range(steps + 1):
        ctes.append(f"a{s} AS MATERIALIZED (SELECT r, vec_id, min(struct_pack(d := vv - 2 * list_dot_product(v, c) + list_dot_product(c, c), j := j)) AS b FROM x, c{s} GROUP BY r, vec_id)")
        if s < steps:
            ctes.append(f"""m{s} AS (SELECT r, j, list(m ORDER BY i) AS m FROM (SELECT r, b.j AS j, i, floor(sum(e) / count(*)) AS m FROM (SELECT a.r, a.b, unnest(x.v) AS e, unnest(range(len(x.v))) AS i FROM a{s} a JOIN x USING (vec_id)) GROUP BY ALL) GROUP BY r, j)""")
            ctes.append(f"c{s + 1} AS MATERIALIZED (SELECT c.r, c.j, coalesce(m, c) AS c FROM c{s} c LEFT JOIN m{s} m ON m.r = c.r AND m.j = c.j)")
    return f"""WITH {", ".join(ctes)}, best AS (SELECT min(struct_pack(cost := cost, r := r)) AS w FROM (SELECT r, sum(b.d) AS cost FROM a{steps} GROUP BY r))
    SELECT vec_id, CAST(b.j AS INTEGER) AS cluster FROM a{steps}, best WHERE r = w.r"""


@query("V1_kmeans_labels", _kmeans_sql(73, 5, 20))
def v1(t):
    return ml.kmeans_labels(t.embeddings.select("vec_id", "embedding"), "embedding", 73, F.col("vec_id")).select("vec_id", "cluster")


def _pca_sql(columns: str, squarings: int = 14) -> str:
    """Two leading eigenvectors of the covariances by squaring the matrix, the second after the first has been taken out."""
    square = lambda name, of: f"{name} AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {of} a JOIN {of} b ON a.j = b.i GROUP BY a.i, b.j))"

    def leading(tag: str, matrix: str) -> list[str]:
        powers = [square(f"{tag}{s}", matrix if s == 0 else f"{tag}{s - 1}") for s in range(squarings)]
        last = f"{tag}{squarings - 1}"
        column = f"SELECT j FROM {last} WHERE i = j ORDER BY v DESC, j LIMIT 1"
        unit = f"{tag}u AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE j = ({column}))"
        sign = f"{tag} AS MATERIALIZED (SELECT i, v * (SELECT sign(v) FROM {tag}u ORDER BY round(abs(v), 9) DESC, i LIMIT 1) AS v FROM {tag}u)"
        return [*powers, unit, sign]

    ctes = [
        "x AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i FROM embeddings)",
        "z AS MATERIALIZED (SELECT vec_id, i, e - avg(e) OVER (PARTITION BY i) AS e FROM x)",
        "cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.e * b.e) AS v FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i)",
        *leading("p", "cov"),
        "l AS (SELECT sum(p.v * cov.v * q.v) AS v FROM p JOIN cov ON cov.i = p.i JOIN p q ON q.i = cov.j)",
        "cut AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - l.v * p.v * q.v AS v FROM cov JOIN p ON p.i = cov.i JOIN p q ON q.i = cov.j, l)",
        *leading("q", "cut"),
    ]
    return f"""WITH {", ".join(ctes)} SELECT {columns}, round(sum(z.e * p.v), 4) AS pc1, round(sum(z.e * q.v), 4) AS pc2 FROM z JOIN p USING (i) JOIN q USING (i) GROUP BY ALL"""


def _r4(*names):
    return [F.round(n, 4).alias(n) for n in names]


@query("V2_pca", _pca_sql("vec_id"))
def v2(t):
    return ml.pca_2d(t.embeddings.select("vec_id", "embedding"), "embedding").select("vec_id", *_r4("pc1", "pc2"))


@query("V3_shared_pca", _pca_sql("CASE WHEN vec_id % 3 = 0 THEN 'labeled' ELSE 'unlabeled' END AS origin, vec_id"))
def v3(t):
    e = t.embeddings.select("vec_id", "embedding")
    return ml.shared_pca(e.where("vec_id % 3 = 0"), e.where("vec_id % 3 > 0"), "embedding").select("origin", "vec_id", *_r4("pc1", "pc2"))


@query("V8_batch_inference", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at, list_max(embedding)::DOUBLE AS most FROM embeddings")
def v8(t):
    return ml.predict_batches(t.embeddings.select("vec_id", "embedding"), ml.peak_predictor, "vec_id bigint, at bigint, most double")
