"""Aggregations and reshapes (A*, R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caliper.functions.stats import masked_mean, rmse
from caliper.operators import relational as rel
from caliper.operators import summaries as sm
from caliper.operators.ordered import interpolated_quantiles, nearest_quantiles, weighted_mean, with_quantiles
from caliper.plans.basics import r6
from caliper.plans.catalog import query

NAN_VALUES = "CASE WHEN value < 20 THEN 'nan'::DOUBLE ELSE value END"


def with_nan(events):
    return events.withColumn("x", F.when(F.col("value") < 20, float("nan")).otherwise(F.col("value")))


@query("A1_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a1(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("A2_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a2(t):
    return sm.duplicate_keys(t.lineitem, ["l_partkey", "l_suppkey"])


@query("A3_median", "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY ALL")
def a3(t):
    return interpolated_quantiles(t.events, ["event_type"], "value", {"m": 0.5}).select("event_type", r6("m").alias("median_value"))


@query("A4_mean", "SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def a4(t):
    return t.events.groupBy("event_type").agg(r6(F.avg("value")).alias("mean_value"))


@query("A5_min_max", "SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL")
def a5(t):
    return t.events.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("A6_nearest_quantiles", """SELECT o_orderpriority, min(o_totalprice) AS lo, v[1 + CAST(round_even(0.25 * (len(v) - 1), 0) AS INT)] AS q1, v[1 + CAST(round_even(0.5 * (len(v) - 1), 0) AS INT)] AS q2,
    v[1 + CAST(round_even(0.75 * (len(v) - 1), 0) AS INT)] AS q3, max(o_totalprice) AS hi
    FROM orders JOIN (SELECT o_orderpriority AS p, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1) ON p = o_orderpriority GROUP BY o_orderpriority, v""")
def a6(t):
    return nearest_quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 1.0})


@query("A7_global_percentiles", "SELECT round(quantile_cont(o_totalprice, 0.75), 6) AS p75, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders")
def a7(t):
    p = interpolated_quantiles(t.orders, [], "o_totalprice", {"p75": 0.75, "p90": 0.9, "p95": 0.95})
    return p.select(*[r6(c).alias(c) for c in p.columns])


@query("A8_sample_std", "SELECT user_id, round(stddev_samp(value), 6) AS sd FROM events GROUP BY ALL")
def a8(t):
    return t.events.groupBy("user_id").agg(r6(F.stddev_samp("value")).alias("sd"))


@query("A9_distinct_per_group", "SELECT l_suppkey, count(DISTINCT nullif(l_partkey % 7, 0)) + max(CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) AS kinds FROM lineitem GROUP BY ALL")
def a9(t):
    kind = F.nullif(F.col("l_partkey") % 7, F.lit(0))
    return t.lineitem.groupBy("l_suppkey").agg(sm.distinct_with_null(kind).alias("kinds"))


@query("A10_distinct_global", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a10(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("A11_conditional_rate", "SELECT l_suppkey, count(*) FILTER (WHERE l_discount < 0.03) AS under, round(count(*) FILTER (WHERE l_discount < 0.03) / count(*)::DOUBLE * 100, 6) AS pct FROM lineitem GROUP BY ALL")
def a11(t):
    return t.lineitem.groupBy("l_suppkey").agg(*sm.rate_under(F.col("l_discount"), 0.03, "under", "pct")).withColumn("pct", r6("pct"))


@query("A12_first_last", "SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL")
def a12(t):
    return t.events.groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@query("A13_last_non_null", "SELECT user_id, arg_max(x, event_id) FILTER (WHERE x IS NOT NULL) AS last_value FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN value END AS x FROM events) GROUP BY ALL")
def a13(t):
    runs = t.events.withColumn("x", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return runs.groupBy("user_id").agg(sm.last_known("x", "event_id").alias("last_value"))


@query("A14_last_by_step", "SELECT event_type, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL")
def a14(t):
    return t.events.groupBy("event_type").agg(F.max_by("value", "event_id").alias("last_value"))


@query("A15_dynamic_aggregates", "SELECT user_id, event_id % 50 AS step, arg_min(event_type, event_id) AS event_type, max(value) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_id % 50")
def a15(t):
    rows = t.events.select("user_id", (F.col("event_id") % 50).alias("step"), "event_type", "value", "event_id")
    return sm.merge_steps(rows, ["user_id", "step"], "event_id")


@query("A16_two_level", "SELECT n_users, count(*) AS types, round(avg(m), 6) AS mean_of_means FROM (SELECT event_type, count(DISTINCT user_id) AS n_users, avg(um) AS m FROM (SELECT event_type, user_id, avg(value) AS um FROM events GROUP BY ALL) GROUP BY event_type) GROUP BY n_users")
def a16(t):
    users = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("um"))
    types = users.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.avg("um").alias("m"))
    return types.groupBy("n_users").agg(F.count(F.lit(1)).alias("types"), r6(F.avg("m")).alias("mean_of_means"))


@query("A17_collect_unique", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY ALL")
def a17(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("A18_collect_structs", "SELECT conv_id, string_agg(role || ':' || len(text), '|' ORDER BY turn, role, len(text)) AS turns FROM conversations GROUP BY ALL")
def a18(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.char_length("text").alias("n"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda s: F.concat(s["role"], F.lit(":"), s["n"].cast("string"))), "|").alias("turns"))


@query("A19_first_row_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def a19(t):
    return rel.first_per_group(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


@query("A20_struct_key", "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL")
def a20(t):
    by = t.lineitem.groupBy(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("k"))
    return by.agg(r6(F.sum("l_quantity")).alias("quantity")).select("k.*", "quantity")


@query("A21_min_across_runs", "SELECT doc_id, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM (SELECT doc_id, n_chars / 10.0::DOUBLE AS x FROM documents UNION ALL SELECT doc_id, 1000 - n_chars / 7.0::DOUBLE FROM documents) GROUP BY ALL")
def a21(t):
    d = t.documents
    runs = rel.union_runs({"a": d.select("doc_id", (F.col("n_chars") / 10.0).alias("x")), "b": d.select("doc_id", (1000 - F.col("n_chars") / 7.0).alias("x"))})
    return sm.across_runs(runs, "doc_id", "x").select("doc_id", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("A22_label_coverage", "SELECT count(DISTINCT label) AS labels FROM (SELECT label FROM embeddings UNION ALL SELECT label + vec_id % 3 FROM embeddings)")
def a22(t):
    e = t.embeddings
    return e.select("label").union(e.select(F.col("label") + F.col("vec_id") % 3)).agg(F.count_distinct("label").alias("labels"))


@query("A23_nan_aware", f"SELECT event_type, round(avg(x), 6) AS mean_x, max(x) AS max_x, round(median(x), 6) AS median_x FROM (SELECT event_type, nullif({NAN_VALUES}, 'nan'::DOUBLE) AS x FROM events) GROUP BY ALL")
def a23(t):
    return sm.nan_summary(with_nan(t.events), ["event_type"], "x").select("event_type", r6("mean").alias("mean_x"), F.col("max").alias("max_x"), r6("median").alias("median_x"))


@query("A24_masked_mean", "SELECT l_suppkey, round(sum(l_tax * (l_quantity > 25)::INT) / greatest(sum((l_quantity > 25)::INT), 1), 6) AS loss FROM lineitem GROUP BY ALL")
def a24(t):
    active = (F.col("l_quantity") > 25).cast("double")
    return t.lineitem.groupBy("l_suppkey").agg(r6(masked_mean(F.col("l_tax"), active)).alias("loss"))


@query("A25_masked_squared_error", "SELECT l_suppkey, round(sum(pow(l_tax - l_discount, 2) * (l_quantity > 25)::INT) / greatest(4.0::DOUBLE * sum((l_quantity > 25)::INT), 1), 6) AS loss FROM lineitem GROUP BY ALL")
def a25(t):
    active = (F.col("l_quantity") > 25).cast("double")
    se = F.pow(F.col("l_tax") - F.col("l_discount"), 2)
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.sum(se * active) / F.greatest(4 * F.sum(active), F.lit(1.0))).alias("loss"))


@query("A26_rater_agreement", "SELECT round(sqrt(avg(pow(l_tax - l_discount, 2))), 6) AS rmse, round(avg(l_tax - l_discount), 6) AS bias, round(regr_r2(l_tax, l_discount), 6) AS r2 FROM lineitem")
def a26(t):
    a, b = F.col("l_tax"), F.col("l_discount")
    return t.lineitem.agg(r6(rmse(a, b)).alias("rmse"), r6(F.avg(a - b)).alias("bias"), r6(F.regr_r2("l_tax", "l_discount")).alias("r2"))


@query("A27_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def a27(t):
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"))


@query("A28_error_types", "SELECT kind AS error, count(*) AS n FROM (SELECT CASE WHEN l_discount = 0 THEN 'no discount' WHEN l_tax = 0 THEN 'no tax' WHEN l_quantity > 49 THEN 'too many' END AS kind FROM lineitem) WHERE kind IS NOT NULL GROUP BY kind")
def a28(t):
    error = F.when(F.col("l_discount") == 0, "no discount").when(F.col("l_tax") == 0, "no tax").when(F.col("l_quantity") > 49, "too many")
    return t.lineitem.select(error.alias("error")).where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("A29_validation_counters", """SELECT l_returnflag AS kind, count(*) AS total, count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 45) AS valid, count(*) FILTER (WHERE l_quantity NOT BETWEEN 5 AND 45) AS out_of_bounds, count(*) FILTER (WHERE l_discount = 0) AS empty FROM lineitem GROUP BY 1""")
def a29(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("d"))).alias("measurements"))
    return sm.validation_counters(nested, "measurements", "kind", lambda m: m["x"].between(5, 45), lambda m: m["d"] == 0)


@query("A30_histogram", "SELECT least(greatest(CAST(floor(value / 10) AS BIGINT), 0), 19) AS bin, count(*) AS n FROM events GROUP BY ALL")
def a30(t):
    return sm.histogram(t.events, "value", 0.0, 200.0, 20)


@query("A31_box_plot", """SELECT event_type, min(value) AS lo, v[1 + CAST(round_even(0.25 * (len(v) - 1), 0) AS INT)] AS q1, v[1 + CAST(round_even(0.5 * (len(v) - 1), 0) AS INT)] AS q2, v[1 + CAST(round_even(0.75 * (len(v) - 1), 0) AS INT)] AS q3, max(value) AS hi
    FROM events JOIN (SELECT event_type AS p, list_sort(list(value)) AS v FROM events GROUP BY 1) ON p = event_type GROUP BY event_type, v""")
def a31(t):
    return sm.box_summary(t.events, ["event_type"], "value")


@query("A32_cluster_coverage", "SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id % 3 = 0) AS priority, round(count(*) FILTER (WHERE vec_id % 3 = 0 AND vec_id % 2 = 0) / nullif(count(*) FILTER (WHERE vec_id % 3 = 0), 0)::DOUBLE, 6) AS selected_share FROM embeddings GROUP BY ALL")
def a32(t):
    rows = t.embeddings.select("label", (F.col("vec_id") % 3 == 0).alias("is_priority"), (F.col("vec_id") % 2 == 0).alias("is_selected"))
    return sm.cluster_coverage(rows, "label").withColumn("selected_share", r6("selected_share"))


@query("A33_point_density", "SELECT a.c_nationkey, a.c_custkey, a.c_acctbal, round(1e6 * avg(exp(-pow(b.c_acctbal::DOUBLE - a.c_acctbal, 2) / (2 * 500.0::DOUBLE * 500))) / (500.0::DOUBLE * sqrt(2 * pi())), 6) AS density_ppm FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY ALL")
def a33(t):
    found = sm.density(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey", "c_acctbal", 500.0)
    return found.select("c_nationkey", "c_custkey", "c_acctbal", r6(F.col("density") * 1e6).alias("density_ppm"))


@query("A34_scale_summary", "SELECT round(avg(p_retailprice), 6) AS mean_scale, round(median(p_retailprice), 6) AS median_scale FROM part")
def a34(t):
    both = with_quantiles(t.part, [], "p_retailprice", {"median": 0.5}, [weighted_mean("p_retailprice").alias("mean")])
    return both.select(r6("mean").alias("mean_scale"), r6("median").alias("median_scale"))


@query("A35_outside_fraction", "SELECT l_returnflag, round(avg(o), 6) AS outside FROM (SELECT l_returnflag, (l_quantity >= 45)::INT::DOUBLE AS o FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('7|' || l_orderkey || '-' || l_linenumber)) <= 500) GROUP BY ALL")
def a35(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    some = sm.seeded_per_group(t.lineitem, ["l_returnflag"], key, 7, 500)
    return some.groupBy("l_returnflag").agg(r6(F.avg(F.when(F.col("l_quantity") >= 45, 1.0).otherwise(0.0))).alias("outside"))


@query("A36_decode_comparison", "SELECT event_type, round(avg(value), 6) AS mean_px, round(median(value), 6) AS median_px, round(quantile_cont(value, 0.95), 6) AS p95_px, round(avg(value / 12.5), 6) AS mean_cm FROM events GROUP BY ALL")
def a36(t):
    means = [weighted_mean("value").alias("mean_px"), (weighted_mean("value") / 12.5).alias("mean_cm")]
    both = with_quantiles(t.events, ["event_type"], "value", {"median_px": 0.5, "p95_px": 0.95}, means)
    return both.select("event_type", *[r6(c).alias(c) for c in ("mean_px", "median_px", "p95_px", "mean_cm")])


@query("R1_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY ALL")
def r1(t):
    sums = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(r6(F.sum("l_quantity")).alias("q"))
    return rel.pivot_first(sums, ["l_returnflag"], "l_linestatus", ["F", "O"], "q")


@query("R2_pivot_delta", "SELECT user_id, event_type, a AS before, b AS after, round(b - a, 6) AS delta FROM (SELECT user_id, event_type, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS a, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS b FROM events GROUP BY ALL)")
def r2(t):
    means = t.events.groupBy("user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("half")).agg(r6(F.avg("value")).alias("m"))
    return rel.pivot_first(means, ["user_id", "event_type"], "half", ["before", "after"], "m").withColumn("delta", r6(F.col("after") - F.col("before")))


@query("R3_pivot_first_by_order", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY ALL")
def r3(t):
    return rel.pivot_first(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O"], "o_totalprice", "o_orderkey")


@query("R4_unpivot", "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def r4(t):
    wide = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot(["s_suppkey"], ["balance", "nation"], "metric", "value")


@query("R5_explode_non_null", "SELECT doc_id, unnest(string_split(source, 'c')) AS piece FROM documents WHERE source IS NOT NULL")
def r5(t):
    return t.documents.select("doc_id", F.explode_outer(F.split("source", "c")).alias("piece")).where("piece is not null")


@query("R6_wide_by_run", "SELECT user_id, max(value) FILTER (WHERE event_id % 3 = 0) AS run0, max(value) FILTER (WHERE event_id % 3 = 1) AS run1, max(value) FILTER (WHERE event_id % 3 = 2) AS run2 FROM events GROUP BY ALL")
def r6_(t):
    runs = t.events.withColumn("run", F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")))
    return runs.groupBy("user_id").pivot("run", ["run0", "run1", "run2"]).agg(F.max("value"))


@query("R7_flat_vector", "SELECT vec_id, round(list_sum(list_concat(embedding[1:4]::DOUBLE[], embedding[9:12]::DOUBLE[])), 6) AS flat FROM embeddings")
def r7(t):
    e = F.col("embedding").cast("array<double>")
    measured = F.array(F.struct(F.lit("width").alias("kind"), F.slice(e, 1, 4).alias("xy")), F.struct(F.lit("length").alias("kind"), F.slice(e, 9, 4).alias("xy")))
    flat = sm.measured(measured, ["width", "length"])
    return t.embeddings.select("vec_id", r6(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)).alias("flat"))


@query("R8_nested_index", "SELECT l_orderkey, l_suppkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS by_type FROM (SELECT l_orderkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def r8(t):
    points = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", F.array("l_quantity").alias("points"))
    index = sm.nested_index(points, ["l_orderkey", "l_suppkey"], "l_returnflag", "points", "by_type")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), F.size(e["value"]).cast("string"))), ",")
    return index.select("l_orderkey", "l_suppkey", text.alias("by_type"))


@query("R9_audit_records", "SELECT l_orderkey, count(*) AS n_errors FROM lineitem WHERE l_quantity > 48 OR l_discount = 0 GROUP BY ALL")
def r9(t):
    li = t.lineitem
    audit = li.groupBy("l_orderkey").agg(F.collect_list(F.when((F.col("l_quantity") > 48) | (F.col("l_discount") == 0), F.struct("l_linenumber", "l_quantity"))).alias("errors"))
    return audit.where(F.size("errors") > 0).select("l_orderkey", F.size("errors").cast("bigint").alias("n_errors"))
