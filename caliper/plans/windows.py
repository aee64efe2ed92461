"""Windows, order and samples, sets, checks, splits, ranking (W*, T*, U*, Q*, V5-V7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caliper.functions import stats as st
from caliper.operators import ingest
from caliper.operators import quality as qa
from caliper.operators import ranking as rk
from caliper.operators import relational as rel
from caliper.operators import splits as sp
from caliper.operators import summaries as sm
from caliper.operators.ordered import placed_within, running_ema, with_percentile_rank
from caliper.plans.basics import r6
from caliper.plans.catalog import query


def run_order():
    return Window.partitionBy("user_id").orderBy("event_id")


@query("W1_any_over", "SELECT event_id, bool_or(value > 300) OVER (PARTITION BY user_id) AS has_large FROM events")
def w1(t):
    return t.events.select("event_id", F.bool_or(F.col("value") > 300).over(Window.partitionBy("user_id")).alias("has_large"))


@query("W2_lag_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def w2(t):
    return t.events.select("event_id", r6(F.col("value") - F.lag("value").over(run_order())).alias("delta"))


@query("W3_percentile_rank", "SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY event_type), 6) AS pr FROM events")
def w3(t):
    return with_percentile_rank(t.events, ["event_type"], "value", "pr").select("event_id", r6("pr").alias("pr"))


@query("W4_top_quota", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 25")
def w4(t):
    return rel.number_within(t.events, ["event_type"], [F.desc("value"), F.col("event_id")], "n").where("n <= 25").select("event_id")


@query("W5_quota", "SELECT label, greatest(1, CAST(round_even(n / 500.0::DOUBLE * 73, 0) AS BIGINT)) AS quota FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def w5(t):
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", st.quota(F.col("n"), F.lit(500.0), 73).alias("quota"))


SPLIT_SQL = """SELECT o_custkey, o_orderkey, n, CASE WHEN row_number() OVER w - 1 < 2 OR coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY md5('42|' || o_orderkey), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 THEN 'val' ELSE 'train' END AS split
    FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) WINDOW w AS (PARTITION BY o_custkey ORDER BY md5('42|' || o_orderkey), o_orderkey)"""


def split_groups(t):
    groups = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sp.prefix_split(groups, "o_custkey", "o_orderkey", "n", 2, 20, 42)


@query("W6_prefix_split", SPLIT_SQL)
def w6(t):
    return split_groups(t)


@query("W7_one_group_per_taxon", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('9|' || o_orderkey), o_orderkey) = 1")
def w7(t):
    return sp.one_group_per_taxon(t.orders, "o_custkey", "o_orderkey", t.orders.where("o_orderkey % 10 = 0"), 9).select("o_custkey", "o_orderkey")


#: The suppliers' nations as taxa, orders as the groups that they share; the loop one group a step.
_LOOP = """WITH RECURSIVE pairs AS (SELECT s_nationkey AS t, l_orderkey AS g, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    taxa AS (SELECT t, row_number() OVER (ORDER BY md5('3|' || t), t) AS i, list(g ORDER BY md5('3|' || g), g) AS gs, list(n ORDER BY md5('3|' || g), g) AS ns FROM pairs GROUP BY t)"""
SEQUENTIAL_SQL = f"""{_LOOP}, s AS (SELECT 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS tg, 0::BIGINT AS tn, []::BIGINT[] AS val UNION ALL
    SELECT CASE WHEN over THEN i + 1 ELSE i END, CASE WHEN over THEN 1 ELSE j + 1 END, CASE WHEN over THEN 0 WHEN held THEN tg ELSE tg + 1 END, CASE WHEN over THEN 0 WHEN held THEN tn ELSE tn + m END, CASE WHEN over OR held THEN val ELSE list_append(val, h) END
    FROM (SELECT s.i, j, tg, tn, val, j > len(gs) OR (tg >= 2 AND tn >= 5) AS over, list_contains(val, gs[j]) AS held, gs[j] AS h, ns[j] AS m FROM s JOIN taxa ON taxa.i = s.i))
    SELECT g AS l_orderkey, CASE WHEN list_contains((SELECT arg_max(val, i * 1000000 + j) FROM s), g) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT g FROM pairs)"""


@query("W6_sequential_split", SEQUENTIAL_SQL)
def w6_sequential(t):
    pairs = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sp.sequential_split(pairs, "s_nationkey", "l_orderkey", "n", 2, 5, 3)


@query("W7_sequential_one_group", f"""{_LOOP.replace("s_nationkey AS t", "l_suppkey AS t")}, s AS (SELECT 1::BIGINT AS i, []::BIGINT[] AS val, NULL::BIGINT AS t, NULL::BIGINT AS g UNION ALL
    SELECT s.i + 1, CASE WHEN list_has_any(val, gs) THEN val ELSE list_append(val, gs[1]) END, CASE WHEN list_has_any(val, gs) THEN NULL ELSE taxa.t END, CASE WHEN list_has_any(val, gs) THEN NULL ELSE gs[1] END FROM s JOIN taxa ON taxa.i = s.i)
    SELECT t AS l_suppkey, g AS l_orderkey FROM s WHERE t IS NOT NULL""")
def w7_sequential(t):
    return sp.sequential_one_group(t.lineitem.select("l_suppkey", "l_orderkey").distinct(), "l_suppkey", "l_orderkey", 3)


@query("W8_running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS covered FROM events")
def w8(t):
    return t.events.select("event_id", r6(st.running(F.sum("value"), run_order())).alias("covered"))


@query("W9_selection_rank", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS selection_rank FROM events")
def w9(t):
    return placed_within(t.events, ["event_type"], [F.desc("value"), F.col("event_id")], "selection_rank").select("event_id", "selection_rank")


@query("W10_ema", """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), e AS (SELECT user_id, n, value AS ema FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, e.ema * 0.9::DOUBLE + s.value * (1 - 0.9::DOUBLE) FROM e JOIN s ON s.user_id = e.user_id AND s.n = e.n + 1)
    SELECT user_id, n AS step, round(ema, 6) AS ema FROM e""")
def w10(t):
    return running_ema(t.events, "user_id", "event_id", "value", 0.9).withColumn("ema", r6("ema"))


@query("W11_positive_differences", "SELECT event_id, d FROM (SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS d FROM events) WHERE d > 0")
def w11(t):
    return t.events.select("event_id", r6(F.col("value") - F.lag("value").over(run_order())).alias("d")).where("d > 0")


@query("W12_pair_at_quantile", "SELECT event_type, n - least(CAST(round_even(0.9 * (c - 1), 0) AS BIGINT), c - 2) - 1 AS side, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE n - 1 - least(CAST(round_even(0.9 * (c - 1), 0) AS BIGINT), c - 2) IN (0, 1)")
def w12(t):
    placed = placed_within(t.events, ["event_type"], [F.col("value"), F.col("event_id")], "n", "c")
    side = F.col("n") - 1 - F.least(F.rint(0.9 * (F.col("c") - 1)).cast("long"), F.col("c") - 2)
    return placed.select("event_type", side.alias("side"), "value").where("side in (0, 1)")


@query("W13_reading_order", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY row_center, x, vec_id) AS position FROM (SELECT vec_id, label, x, avg(floor(y * 2)) OVER (PARTITION BY label, floor(y * 2)) AS row_center FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings))")
def w13(t):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.floor(F.col("embedding")[1].cast("double") * 2).alias("band"))
    centers = rows.groupBy("label", "band").agg(F.avg("band").alias("row_center"))
    centered = rows.join(centers, ["label", "band"])
    return placed_within(centered, ["label"], [F.col("row_center"), F.col("x"), F.col("vec_id")], "position").select("vec_id", "position")


@query("W14_marked_row_first", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error'), value, event_id) AS position FROM events")
def w14(t):
    return rel.number_within(t.events, ["user_id"], [F.col("event_type") != "error", F.col("value"), F.col("event_id")], "position").select("event_id", "position")


@query("W15_tail_split", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) > count(*) OVER (PARTITION BY event_type) - greatest(1, CAST(round_even(count(*) OVER (PARTITION BY event_type) * 0.1::DOUBLE, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM events")
def w15(t):
    return sp.tail_split(t.events, ["event_type"], "event_id", 0.1).select("event_id", "split")


@query("W16_batch_id", "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 256 AS batch FROM events")
def w16(t):
    return placed_within(t.events, ["event_type"], [F.col("event_id")], "n").select("event_id", F.floor((F.col("n") - 1) / 256).alias("batch"))


@query("T1_multi_key_sort", "SELECT row_number() OVER (ORDER BY x ASC NULLS FIRST, o_totalprice DESC NULLS FIRST, o_orderkey) AS place, o_orderkey FROM (SELECT *, nullif(o_custkey % 5, 0) AS x FROM orders)")
def t1(t):
    keys = [F.col("x").asc_nulls_first(), F.col("o_totalprice").desc_nulls_first(), F.col("o_orderkey")]
    return placed_within(t.orders.withColumn("x", F.nullif(F.col("o_custkey") % 5, F.lit(0))), [], keys, "place").select("place", "o_orderkey")


@query("T2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t2(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("T3_best_run_curve", "SELECT event_id, value FROM events WHERE user_id = (SELECT user_id FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) ORDER BY m, user_id LIMIT 1)")
def t3(t):
    best = t.events.groupBy("user_id").agg(F.avg("value").alias("m")).agg(F.min(F.struct("m", "user_id")).alias("b")).select(F.col("b.user_id").alias("user_id"))
    return t.events.join(best, "user_id", "left_semi").select("event_id", "value")


@query("T4_skip_first", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def t4(t):
    return rel.number_within(t.events, ["user_id"], [F.col("event_id")], "n").where("n > 1").select("event_id")


@query("T5_worst_finite", "SELECT event_id, x FROM (SELECT event_id, CASE WHEN value > 200 THEN 'nan'::DOUBLE ELSE value END AS x FROM events) WHERE isfinite(x) ORDER BY x DESC, event_id LIMIT 20")
def t5(t):
    from caliper.sources.readers import is_finite

    x = F.when(F.col("value") > 200, float("nan")).otherwise(F.col("value"))
    return t.events.select("event_id", x.alias("x")).where(is_finite(F.col("x"))).orderBy(F.desc("x"), "event_id").limit(20)


@query("T6_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('17|' || o_orderkey) LIMIT 200")
def t6(t):
    return t.orders.orderBy(st.seeded_order(F.col("o_orderkey"), 17)).limit(200).select("o_orderkey")


@query("T7_seeded_shuffle", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3|' || c_custkey)) AS place FROM customer")
def t7(t):
    return placed_within(t.customer, ["c_mktsegment"], [st.seeded_order(F.col("c_custkey"), 3)], "place").select("c_mktsegment", "c_custkey", "place")


@query("T8_fixed_index_set", "SELECT doc_id FROM documents ORDER BY md5('8|' || doc_id) LIMIT 64")
def t8(t):
    return t.documents.orderBy(st.seeded_order(F.col("doc_id"), 8)).limit(64).select("doc_id")


@query("T9_stratified_subsample", "SELECT event_id FROM events WHERE event_type = 'error' UNION ALL (SELECT event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('5|' || event_id)) <= 100)")
def t9(t):
    rest = sm.seeded_per_group(t.events.where("event_type <> 'error'"), ["event_type"], F.col("event_id"), 5, 100)
    return t.events.where("event_type = 'error'").unionByName(rest).select("event_id")


@query("T10_one_in_n", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('2|' || o_orderkey), 1, 8) AS BIGINT) % 5 = 0")
def t10(t):
    return t.orders.where(st.seeded_bucket(F.col("o_orderkey"), 2, 5) == 0).select("o_orderkey")


@query("U1_concat", "SELECT s_suppkey AS k, s_name AS name, 'supplier' AS run_id FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer")
def u1(t):
    return rel.union_runs({"supplier": t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "customer": t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))})


@query("U2_union_distinct", "SELECT l_partkey FROM lineitem WHERE l_quantity > 48 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def u2(t):
    return t.lineitem.where("l_quantity > 48").select("l_partkey").union(t.lineitem.where("l_discount > 0.09").select("l_partkey")).distinct()


@query("U3_distinct", "SELECT DISTINCT lang, source FROM documents")
def u3(t):
    return t.documents.select("lang", "source").distinct()


@query("U4_last_source_wins", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS origin FROM orders")
def u4(t):
    both = [t.orders.select("o_orderkey", F.lit("first").alias("origin")), t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("second").alias("origin"))]
    return rel.last_source_wins(both, "o_orderkey")


@query("U5_first_occurrence_wins", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_key, doc_id FROM documents) GROUP BY 1")
def u5(t):
    keyed = t.documents.select(F.md5(F.encode("text", "utf-8")).alias("text_key"), "doc_id")
    return keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))


@query("U6_key_set_difference", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.08")
def u6(t):
    a = t.lineitem.where("l_quantity > 40").select(F.col("l_suppkey").alias("k"))
    return a.subtract(t.lineitem.where("l_quantity > 49.5 and l_discount > 0.08").select("l_suppkey"))


@query("U7_append_validated", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def u7(t):
    new = t.orders.where("o_orderstatus = 'O' and o_totalprice > 1000")
    return t.orders.where("o_orderstatus = 'F'").unionByName(rel.absent(new, t.orders.where("o_orderstatus = 'F'"), {"o_orderkey": "o_orderkey"})).select("o_orderkey")


@query("U8_merged_boxes", """WITH RECURSIVE b AS (SELECT vec_id % 40 AS image, vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings),
    p AS (SELECT a.image, a.id AS u, c.id AS v FROM b a JOIN b c ON a.image = c.image AND a.x <= c.x + 4 AND c.x <= a.x + 4 AND a.y <= c.y + 4 AND c.y <= a.y + 4),
    reach AS (SELECT image, id AS u, id AS v FROM b UNION SELECT reach.image, reach.u, p.v FROM reach JOIN p ON p.image = reach.image AND p.u = reach.v)
    SELECT image, u AS id, min(v) AS component FROM reach GROUP BY ALL""")
def u8(t):
    e = lambda i: F.col("embedding")[i].cast("double")
    boxes = t.embeddings.select((F.col("vec_id") % 40).alias("image"), F.col("vec_id").alias("id"), (e(0) * 10).alias("x0"), (e(0) * 10 + 4).alias("x1"), (e(1) * 10).alias("y0"), (e(1) * 10 + 4).alias("y1"))
    return rel.merge_boxes(boxes, "image", 4.0).select("image", "id", "component")


@query("U9_proportional_mix", "SELECT source, k, round((row_number() OVER (PARTITION BY source ORDER BY k) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source), 6) AS at FROM (SELECT 0 AS source, s_suppkey AS k FROM supplier UNION ALL SELECT 1, c_custkey FROM customer)")
def u9(t):
    mixed = rel.proportional_mix([t.supplier.select(F.col("s_suppkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))], "k")
    return mixed.select("source", "k", r6("at").alias("at"))


@query("U10_concat_with_empty", "SELECT r_regionkey, r_name FROM region")
def u10(t):
    return t.region.unionByName(t.region.where("r_regionkey < 0"))


@query("Q2_duplicate_keys", "SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def q2(t):
    return sm.duplicate_keys(t.documents.select(F.md5(F.encode("text", "utf-8")).alias("text_key")), ["text_key"])


@query("Q3_orphans", "SELECT 'events' AS side, user_id AS k FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT user_id FROM events)")
def q3(t):
    return rel.orphans(t.events.select(F.col("user_id").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), "k", "events", "supplier")


@query("Q4_missing_or_empty_files", "SELECT n::BIGINT AS part, CASE WHEN n < 3 THEN 'empty' ELSE 'missing' END AS problem FROM (SELECT unnest([1, 2, 3, 4]) AS n)")
def q4(t):
    from caliper.sources.scratch import scratch_path

    path = scratch_path(t.spark, "files")
    rows = t.spark.range(3).select(F.when(F.col("id") == 0, "x").otherwise("").alias("value"))
    for i in range(3):
        rows.where(F.col("id") == i).coalesce(1).write.option("lineSep", " ").text(f"{path}/part={i}")
    expected = t.spark.range(5).select(F.col("id").alias("part"))
    found = qa.listed_parts(t.spark, path, "part")
    return qa.file_problems(expected, found, "part", least_bytes=2)


@query("Q7_bounds", "SELECT vec_id, embedding[1]::DOUBLE BETWEEN -0.1::DOUBLE AND 0.3::DOUBLE + 0.1::DOUBLE AND embedding[2]::DOUBLE BETWEEN -0.1::DOUBLE AND 0.2::DOUBLE + 0.1::DOUBLE AS ok FROM embeddings")
def q7(t):
    from caliper.functions.arrays import in_bounds

    xy = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    return t.embeddings.select("vec_id", in_bounds(xy, F.lit(0.3), F.lit(0.2), 0.1).alias("ok"))


@query("Q5_child_not_smaller", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= o_totalprice")
def q5(t):
    parent = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return qa.larger_than_parent(t.lineitem, parent, "l_orderkey", "l_extendedprice", "o_totalprice").select("l_orderkey", "l_linenumber", "l_partkey")


@query("Q6_missing_required", "SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS no_x, count(*) FILTER (WHERE y IS NULL) AS no_y FROM (SELECT nullif(l_discount, 0) AS x, nullif(l_tax, 0) AS y FROM lineitem)")
def q6(t):
    rows = t.lineitem.select(F.nullif("l_discount", F.lit(0.0)).alias("x"), F.nullif("l_tax", F.lit(0.0)).alias("y"))
    return qa.missing_counts(rows, ["x", "y"])


@query("Q6_complete_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def q6b(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("x"), F.nullif("l_tax", F.lit(0.0)).alias("y"))
    return qa.complete_rows(rows, ["x", "y"]).select("l_orderkey", "l_linenumber")


@query("Q8_expected_counts", "SELECT (SELECT count(*) FROM documents) AS expected, (SELECT count(DISTINCT doc_id) FROM labels) AS actual, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels) AS missing")
def q8(t):
    return qa.expected_counts(t.documents, t.labels.select("doc_id").distinct())


@query("Q9_rename_conflicts", "SELECT 'c' || c_custkey AS path, 'source missing' AS conflict FROM customer WHERE c_custkey % 3 > 0 AND 'c' || c_custkey NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'c' || (c_custkey + 1), 'target exists' FROM customer WHERE c_custkey % 3 > 0 AND 'c' || (c_custkey + 1) IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def q9(t):
    path = lambda k: F.concat(F.lit("c"), k.cast("string"))
    there = t.customer.where("c_custkey % 2 = 0").select(path(F.col("c_custkey")).alias("path"))
    log = t.customer.where("c_custkey % 3 > 0").select(path(F.col("c_custkey")).alias("old"), path(F.col("c_custkey") + 1).alias("new"))
    return qa.rename_conflicts(log, there, "old", "new", "path")


REPORT_SQL = f"SELECT o_custkey, count(*) AS groups, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (WHERE split = 'val') AS val_groups, CAST(coalesce(sum(n) FILTER (WHERE split = 'val'), 0) AS BIGINT) AS val_items FROM ({SPLIT_SQL}) GROUP BY 1"


@query("Q10_split_below_threshold", f"SELECT o_custkey, groups, val_groups, val_items FROM ({REPORT_SQL}) WHERE val_groups < 2 OR val_items < 20")
def q10(t):
    report = sp.split_report(split_groups(t), "o_custkey", "n")
    return report.where(sp.below_threshold(report, 2, 20)).select("o_custkey", "groups", "val_groups", "val_items")


@query("Q11_split_kind", f"SELECT o_custkey, CASE WHEN val_groups = groups THEN 'ALL VAL' ELSE 'MIXED' END AS kind, round(val_items / items::DOUBLE * 100, 6) AS val_pct FROM ({REPORT_SQL})")
def q11(t):
    return sp.split_report(split_groups(t), "o_custkey", "n").select("o_custkey", "kind", r6("val_pct").alias("val_pct"))


@query("Q13_trusted_annotator", """WITH m AS (SELECT user_id AS entity, event_id, CASE WHEN event_id % 2 = 0 THEN 'length' ELSE 'width' END AS kind, event_type AS annotator FROM events), h AS (SELECT *, bool_or(annotator = 'error' AND kind = 'length') OVER (PARTITION BY entity) AS hl, bool_or(annotator = 'error' AND kind = 'width') OVER (PARTITION BY entity) AS hw FROM m)
    SELECT entity, kind, annotator, event_id FROM h WHERE (NOT hl AND NOT hw) OR annotator = 'error' OR (NOT hl AND kind = 'length') OR (NOT hw AND kind = 'width') QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY event_id) = 1""")
def q13(t):
    m = t.events.select(F.col("user_id").alias("entity"), "event_id", F.when(F.col("event_id") % 2 == 0, "length").otherwise("width").alias("kind"), F.col("event_type").alias("annotator"))
    return qa.trusted_measurements(m, "entity", "kind", "annotator", "error", "event_id").select("entity", "kind", "annotator", "event_id")


@query("Q14_validity_accuracy", "SELECT l_returnflag, count(*) AS checked, count(*) FILTER (WHERE l_quantity < 45) AS valid, round(count(*) FILTER (WHERE l_quantity < 45) / count(*)::DOUBLE * 100, 6) AS accuracy FROM lineitem GROUP BY 1")
def q14(t):
    return t.lineitem.groupBy("l_returnflag").agg(*qa.accuracy(F.col("l_quantity") < 45)).withColumn("accuracy", r6("accuracy"))


@query("Q15_rollback_log", "SELECT c_custkey, 'new' || c_custkey AS old_path, 'old' || c_custkey AS new_path FROM customer")
def q15(t):
    log = t.customer.select("c_custkey", F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("old_path"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("new_path"))
    return qa.rollback(log, [("old_path", "new_path")])


RUNS_SQL = """runs AS (SELECT 'a' AS run_id, vec_id, 'g' || (vec_id % 37) AS grp, label AS cluster, abs(embedding[1])::DOUBLE AS mean_entropy FROM embeddings UNION ALL SELECT 'b', vec_id, 'g' || (vec_id % 37), (label + vec_id % 2)::INT, abs(embedding[2])::DOUBLE FROM embeddings),
    norm AS (SELECT *, (rank() OVER (PARTITION BY run_id ORDER BY mean_entropy) + (count(*) OVER (PARTITION BY run_id, mean_entropy) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_id) AS norm_entropy FROM runs),
    prior AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY run_id, cluster ORDER BY norm_entropy DESC, vec_id) AS place, greatest(1, round_even(count(*) OVER (PARTITION BY run_id, cluster) / (count(*) OVER (PARTITION BY run_id))::DOUBLE * 60, 0)) AS q FROM norm) WHERE place <= q),
    items AS (SELECT vec_id, grp, min(norm_entropy) AS score FROM norm GROUP BY ALL),
    scores AS (SELECT grp, count(*) AS n_all, count(prior.vec_id) AS n_priority, sum(CASE WHEN prior.vec_id IS NOT NULL THEN score END) AS raw FROM items LEFT JOIN prior USING (vec_id) GROUP BY grp HAVING count(prior.vec_id) > 0),
    best AS (SELECT *, raw / n_all AS score FROM scores ORDER BY round(raw / n_all, 9) DESC, grp LIMIT 15)"""


def ranking_runs(t):
    e = t.embeddings
    a = e.select(F.lit("a").alias("run_id"), "vec_id", F.concat(F.lit("g"), (F.col("vec_id") % 37).cast("string")).alias("grp"), F.col("label").alias("cluster"), F.abs(F.col("embedding")[0]).cast("double").alias("mean_entropy"))
    b = e.select(F.lit("b").alias("run_id"), "vec_id", F.concat(F.lit("g"), (F.col("vec_id") % 37).cast("string")).alias("grp"), (F.col("label") + F.col("vec_id") % 2).cast("int").alias("cluster"), F.abs(F.col("embedding")[1]).cast("double").alias("mean_entropy"))
    return a.unionByName(b)


@query("V5_quota_selection", f"WITH {RUNS_SQL} SELECT vec_id FROM prior")
def v5(t):
    return rk.priority(rk.normalized(ranking_runs(t)), "vec_id", 60)


@query("V6_group_cover", f"WITH {RUNS_SQL} SELECT grp, n_all, n_priority, round(raw, 4) AS entropy_covered, row_number() OVER (ORDER BY round(score, 9) DESC, grp) AS group_rank, CAST(sum(n_priority) OVER (ORDER BY round(score, 9) DESC, grp) AS BIGINT) AS cumulative_priority_covered FROM best")
def v6(t):
    groups, _, _ = rk.rank_for_annotation(ranking_runs(t), "vec_id", "grp", 60, 15)
    return groups.select("grp", "n_all", "n_priority", F.round("raw", 4).alias("entropy_covered"), "group_rank", "cumulative_priority_covered")


@query("V7_ranked_items", f"WITH {RUNS_SQL} SELECT i.vec_id, i.grp, round(i.score, 6) AS score, r.group_rank, p.vec_id IS NOT NULL AS is_priority FROM items i JOIN (SELECT grp, row_number() OVER (ORDER BY round(score, 9) DESC, grp) AS group_rank FROM best) r USING (grp) LEFT JOIN prior p ON p.vec_id = i.vec_id")
def v7(t):
    _, chosen, _ = rk.rank_for_annotation(ranking_runs(t), "vec_id", "grp", 60, 15)
    return chosen.select("vec_id", "grp", r6("score").alias("score"), "group_rank", "is_priority")


@query("V7_all_unlabeled", f"WITH {RUNS_SQL} SELECT i.vec_id, i.grp, round(i.score, 6) AS score, p.vec_id IS NOT NULL AS is_priority, c.clusters FROM items i LEFT JOIN prior p ON p.vec_id = i.vec_id JOIN (SELECT vec_id, string_agg(cluster::VARCHAR, ',' ORDER BY cluster) AS clusters FROM (SELECT DISTINCT vec_id, cluster FROM norm) GROUP BY 1) c ON c.vec_id = i.vec_id")
def v7b(t):
    _, _, all_ = rk.rank_for_annotation(ranking_runs(t), "vec_id", "grp", 60, 15)
    return all_.select("vec_id", "grp", r6("score").alias("score"), "is_priority", "clusters")


#: Orders as group images, their lines as specimens: raw trait and image tables with texts that do not parse, lines of odd
#: length, keys that repeat and keys that only one of the tables has.
def _raw_tables(t):
    line = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").cast("bigint").alias("q"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    group = text("group_images/O", F.col("l_orderkey").cast("string"), ".png")
    q, p = F.col("q").cast("string"), F.col("l_partkey").cast("string")
    traits = line.where("l_linenumber <> 2").select(
        group.alias("groupImageFilePath"),
        F.col("l_linenumber").cast("string").alias("BeetlePosition"),
        F.when(F.col("l_orderkey") % 2 == 0, text("[[", q, ",0,", q, ",", p, "]]")).otherwise(text("[[", q, ",0,", q, "]]")).alias("coords_scalebar"),
        text("[[", p, ",", q, ",0,1],[", q, "]]").alias("coords_elytra_max_length"),
        F.lit("oops").alias("coords_basal_pronotum_width"),
        F.lit("[]").alias("coords_elytra_max_width"),
    )
    copies = F.when(F.col("BeetlePosition") == "3", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    traits = traits.withColumn("copy", F.explode(copies)).drop("copy")
    images = line.where("l_linenumber <> 4").select(group.alias("groupImageFilePath"), text("individual/O", F.col("l_orderkey").cast("string"), "_specimen_", F.col("l_linenumber").cast("string"), ".png").alias("individualImageFilePath"))
    origins = line.select(ingest.group_basename(group).alias(ingest.KEYS[0]), F.col("l_linenumber").cast("bigint").alias(ingest.KEYS[1]), F.lit(10).alias("origin_x"), F.col("l_linenumber").alias("origin_y"))
    return ingest.keyed_traits(traits), ingest.keyed_images(images), origins


@query("E1_ingest_documents", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linenumber NOT IN (2, 4) GROUP BY ALL)
    SELECT 'o' || o AS group_img_basename, CAST(n AS BIGINT) AS beetle_position, 'scalebar' AS measurement_type, concat_ws(',', q - 10, 0 - n, q - 10, p - n) AS polyline FROM l WHERE o % 2 = 0
    UNION ALL SELECT 'o' || o, CAST(n AS BIGINT), 'elytra_max_length', concat_ws(',', p - 10, q - n, -10, 1 - n) FROM l""")
def e1(t):
    """Raw tables to annotation documents, one measurement a row."""
    docs = ingest.annotation_documents(*_raw_tables(t))
    m = docs.select(*ingest.KEYS, F.explode("measurements").alias("m")).select(*ingest.KEYS, "m.*")
    return m.select(*ingest.KEYS, "measurement_type", F.array_join(F.transform("polyline_px", lambda x: x.cast("bigint").cast("string")), ",").alias("polyline"))


@query("E2_ingest_problems", """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    SELECT 'trait_duplicates' AS problem, 'o' || l_orderkey AS group_img_basename, CAST(l_linenumber AS BIGINT) AS beetle_position, 2 AS n FROM l WHERE l_linenumber = 3
    UNION ALL SELECT 'images_without_traits', 'o' || l_orderkey, CAST(l_linenumber AS BIGINT), 1 FROM l WHERE l_linenumber = 2
    UNION ALL SELECT 'traits_without_images', 'o' || l_orderkey, CAST(l_linenumber AS BIGINT), 1 FROM l WHERE l_linenumber = 4""")
def e2(t):
    traits, images, _ = _raw_tables(t)
    return ingest.key_problems(traits, images)
