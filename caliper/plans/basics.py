"""Projections, filters, joins (P*, F*, J*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliper.functions.stats import percent_error
from caliper.operators import relational as rel
from caliper.plans.catalog import query
from caliper.sources.readers import list_files
from caliper.sources.scratch import scratch_path
from caliper.sources.readers import is_finite


def r6(x):
    return F.round(x, 6)


@query("E0_group_error_summary", """
    SELECT p_brand, count(*) AS n, round(median(e), 6) AS median_err, round(avg(e), 6) AS mean_err
    FROM (SELECT p_brand, l_discount * l_extendedprice / nullif(l_extendedprice + l_tax, 0) * 100 AS e
          FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE isfinite(e) GROUP BY p_brand""")
def group_error_summary(t) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    e = percent_error(F.col("l_discount") * F.col("l_extendedprice"), F.col("l_extendedprice") + F.col("l_tax"))
    return rel.error_summary(rows.select("p_brand", e.alias("e")), "p_brand", "e").select("p_brand", "n", r6("median").alias("median_err"), r6("mean").alias("mean_err")).orderBy("p_brand")


@query("P1_select_rename_drop", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice FROM orders")
def select_rename(t):
    return t.orders.withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer_id"}).drop("o_orderstatus", "o_orderdate", "o_orderpriority")


@query("P2_derived_columns", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,
    round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem""")
def derived(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(net).alias("net"), r6(net * (1 + F.col("l_tax"))).alias("gross"))


@query("P3_literal_tag", "SELECT s_suppkey, s_name, 'base' AS run_id FROM supplier")
def tagged(t):
    return t.supplier.select("s_suppkey", "s_name", F.lit("base").alias("run_id"))


@query("P4_percent_error", """SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0) * 100, 6) AS pct FROM lineitem""")
def pct_error(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(percent_error(F.col("l_tax"), F.col("l_discount"))).alias("pct"))


@query("P5_case_when", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS size_class FROM lineitem""")
def case_when(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(q < 10, "small").when(q < 30, "middle").otherwise("large").alias("size_class"))


@query("P6_cast", """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, TRY_CAST(o_orderpriority AS BIGINT) AS none, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders""")
def casts(t):
    return t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("bigint").alias("level"), F.col("o_orderpriority").try_cast("bigint").alias("none"), F.col("o_totalprice").cast("bigint").alias("whole"))


@query("P7_attached_vector", "SELECT s_suppkey, round(s_acctbal / max(s_acctbal) OVER (), 6) AS share FROM supplier")
def attached(t):
    top = t.supplier.agg(F.max("s_acctbal")).scalar()
    return t.supplier.select("s_suppkey", r6(F.col("s_acctbal") / top).alias("share"))


@query("P8_struct_flatten", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def struct_flatten(t):
    return t.nation.select("n_nationkey", F.struct("n_name", "n_regionkey").alias("m")).select("n_nationkey", "m.*")


@query("F1_boolean_filters", """SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_quantity >= 10 AND NOT (l_returnflag = 'R') AND (l_discount > 0.05 OR l_tax < 0.02)""")
def boolean_filters(t):
    return t.lineitem.where((F.col("l_quantity") >= 10) & ~(F.col("l_returnflag") == "R") & ((F.col("l_discount") > 0.05) | (F.col("l_tax") < 0.02))).select("l_orderkey", "l_linenumber")


@query("F2_null_tests", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_discount, 0) IS NULL AND nullif(l_tax, 0) IS NOT NULL")
def null_tests(t):
    return t.lineitem.where(F.nullif("l_discount", F.lit(0.0)).isNull() & F.nullif("l_tax", F.lit(0.0)).isNotNull()).select("l_orderkey", "l_linenumber")


@query("F3_is_finite", """SELECT l_orderkey, l_linenumber, round(x, 6) AS x FROM (SELECT *, CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_discount / l_tax END AS x FROM lineitem) WHERE isfinite(x)""")
def finite(t):
    x = F.when(F.col("l_discount") == 0, float("nan")).when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide("l_discount", "l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x")).where(is_finite(F.col("x"))).withColumn("x", r6("x"))


@query("F4_is_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def is_in(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("F5_not_in", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def not_in(t):
    return rel.absent(t.customer, t.orders.where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("F6_regex_filter", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, 'LARGE|PROMO')")
def regex_filter(t):
    return t.part.where(F.col("p_type").rlike("LARGE|PROMO")).select("p_partkey", "p_type")


@query("F7_forall_nested", """SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity <= 40)""")
def forall_nested(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("measurements"))
    return nested.where(F.forall("measurements", lambda q: q <= 40)).select("l_orderkey")


@query("F8_equals_group_max", """SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_extendedprice = m""")
def group_max(t):
    return t.lineitem.withColumn("m", F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))).where("l_extendedprice = m").select("l_orderkey", "l_linenumber")


@query("F9_lookup_as_join", "SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@query("F10_boolean_sum", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount = 0) AS undiscounted FROM lineitem")
def boolean_sum(t):
    return t.lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") == 0).alias("undiscounted"))


@query("J1_inner_join", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("J2_chained_join", """SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_quantity > 45) b ON pk = l_partkey AND sk = l_suppkey""")
def chained(t):
    big = t.lineitem.where("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    li = t.lineitem.join(big, ["l_partkey", "l_suppkey"])
    return li.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("J3_left_join_fill_zero", """SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_fill(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n_orders"])


@query("J4_left_join_match_rate", """SELECT count(*) AS n, count(l.doc_id) AS matched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def match_rate(t):
    known = t.labels.select("doc_id").distinct().withColumn("known", F.lit(True))
    return t.documents.select("doc_id").join(known, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNotNull()).alias("matched"))


@query("J5_left_join_renamed", """SELECT d.doc_id, d.lang, l.quality AS quality_right, l.toxic AS toxic_right FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_renamed(t):
    return rel.left_join_suffixed(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"], "_right")


@query("J6_orphans_both_ways", """SELECT 'customer' AS side, c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
    UNION ALL SELECT 'orders', o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def orphans(t):
    return rel.orphans(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k", "customer", "orders")


@query("J7_exclude_labeled", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude(t):
    return rel.absent(t.documents, t.labels, {"doc_id": "doc_id"}).select("doc_id", "source")


@query("J8_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi(t):
    return rel.present(t.lineitem, t.orders.where("o_orderpriority = '1-URGENT'"), {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("J9_one_to_many_index", """SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def one_to_many(t):
    many = rel.children(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey", "parts")
    return t.orders.join(many, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query("J10_key_overlap", """SELECT count(*) FILTER (WHERE a AND b) AS both_sides, count(*) FILTER (WHERE a AND b IS NULL) AS left_only, count(*) FILTER (WHERE b AND a IS NULL) AS right_only
    FROM (SELECT DISTINCT o_custkey AS k, true AS a FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT o_custkey AS k, true AS b FROM orders WHERE o_orderstatus = 'O') USING (k)""")
def overlap(t):
    key = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return rel.key_overlap(key("F"), key("O"), "k")


@query("J11_aligned_runs", """SELECT a.doc_id, round(a.x, 6) AS first_run, round(b.x, 6) AS second_run FROM (SELECT doc_id, n_chars / 10.0::DOUBLE AS x FROM documents) a JOIN (SELECT doc_id, n_chars / 7.0::DOUBLE AS x FROM documents) b ON a.doc_id = b.doc_id""")
def aligned(t):
    run = lambda k: t.documents.select("doc_id", (F.col("n_chars") / F.lit(float(k))).alias("x"))
    return rel.align_runs([run(10), run(7)], "doc_id").select("doc_id", r6("x_0").alias("first_run"), r6("x_1").alias("second_run"))


@query("J12_seen_tag", """SELECT s_suppkey, CASE WHEN n IS NULL THEN 'unseen' ELSE 'seen' END AS tag FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate < DATE '1993-06-01' GROUP BY 1) ON s_suppkey = l_suppkey""")
def seen(t):
    train = t.lineitem.where("l_shipdate < DATE'1993-06-01'").select(F.col("l_suppkey").alias("s_suppkey"))
    return rel.tag_seen(t.supplier.select("s_suppkey"), train, "s_suppkey", "tag")


@query("J13_missing_files", "SELECT n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def missing_files(t):
    """Nations without a file, where each nation with rich suppliers has its folder."""
    path = scratch_path(t.spark, "listing")
    t.supplier.where("s_acctbal > 9000").select("s_nationkey", "s_name").write.partitionBy("s_nationkey").parquet(path)
    there = list_files(t.spark, path, "part-*").select(F.regexp_extract("path", r"s_nationkey=(\d+)/", 1).cast("int").alias("n"))
    return rel.absent(t.nation.select(F.col("n_nationkey").alias("n")), there, {"n": "n"})


@query("J14_tolerance_pairs", """SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
    WHERE abs(a.l_quantity - b.l_quantity) <= 1 OR abs(a.l_extendedprice - b.l_extendedprice) <= 500""")
def tolerance(t):
    pairs = rel.pairs_within(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_orderkey", "l_linenumber", {"l_quantity": 1, "l_extendedprice": 500})
    return pairs.select("l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"))
