"""Sources, sinks and streams (S*, K*, ST*). Files are written to the shared scratch folder and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from caliper.operators import ml
from caliper.operators import quality as qa
from caliper.operators import rasters as ra
from caliper.operators import relational as rel
from caliper.plans.basics import r6
from caliper.plans.catalog import query
from caliper.sources import images as im
from caliper.sources import models as mo
from caliper.sources import readers as rd
from caliper.sources import sinks as sk
from caliper.sources.scratch import scratch_path
from caliper.sources.versions import VersionedTables, rewrite_keys
from caliper.streaming.history import latest_into, windowed_history


@query("S1_parquet_scan", "SELECT * FROM nation")
def s1(t):
    return t.nation


@query("S2_parquet_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def s2(t):
    return t.lineitem.select("l_orderkey", "l_quantity")


@query("S3_runs_by_path", "SELECT 'first' AS run_id, s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'second', s_suppkey, -s_acctbal FROM supplier")
def s3(t):
    path = scratch_path(t.spark, "runs")
    t.supplier.select("s_suppkey", "s_acctbal").write.parquet(f"{path}/first.parquet")
    t.supplier.select("s_suppkey", (-F.col("s_acctbal")).alias("s_acctbal")).write.parquet(f"{path}/second.parquet")
    return rd.read_runs(t.spark, [f"{path}/first.parquet", f"{path}/second.parquet"]).select("run_id", "s_suppkey", "s_acctbal")


@query("S4_csv_scan", "SELECT n_nationkey, n_name FROM nation")
def s4(t):
    path = scratch_path(t.spark, "csv")
    sk.write_csv(t.nation.select("n_nationkey", "n_name"), path)
    return rd.read_csv(t.spark, path, "n_nationkey int, n_name string")


@query("S5_csv_null_tokens", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS bal FROM customer")
def s5(t):
    path = scratch_path(t.spark, "csv")
    token = F.element_at(F.array(F.lit("NA"), F.lit("N/A"), F.lit("-Inf")), (F.col("c_custkey") % 3 + 1).cast("int"))
    sk.write_csv(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal").cast("string")).otherwise(token).alias("bal")), path)
    return rd.read_csv(t.spark, path, "c_custkey bigint, bal double", rd.NULL_TOKENS)


@query("S6_csv_rows_filtered", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 2 = 0")
def s6(t):
    path = scratch_path(t.spark, "csv")
    key = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("bad key")
    sk.write_csv(t.supplier.select(key.alias("s_suppkey"), "s_acctbal"), path)
    rows = rd.read_csv(t.spark, path, "s_suppkey string, s_acctbal double")
    return rows.where("s_acctbal > 0").select(F.col("s_suppkey").try_cast("bigint").alias("s_suppkey")).where("s_suppkey is not null")


def _text_file(df, column: str, path: str) -> None:
    """One small document as one file."""
    df.select(column).coalesce(1).write.text(path)


@query("S7_json_array", "SELECT n_nationkey, n_name FROM nation")
def s7(t):
    path = scratch_path(t.spark, "json")
    doc = t.nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("doc"))
    _text_file(doc, "doc", path)
    return rd.read_json_array(t.spark, path, "n_nationkey int, n_name string")


@query("S8_keyed_json", "SELECT n_name AS path, n_regionkey AS region FROM nation")
def s8(t):
    path = scratch_path(t.spark, "json")
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_regionkey").alias("region")))))
    _text_file(t.nation.agg(F.to_json(entries).alias("doc")), "doc", path)
    return rd.read_keyed_json(t.spark, path, "struct<region:int>", "path")


@query("S9_indexed_annotations", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s9(t):
    path = scratch_path(t.spark, "json")
    images = t.region.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("images"))
    notes = t.nation.agg(F.collect_list(F.struct(F.col("n_regionkey").alias("image_id"), "n_nationkey", "n_name")).alias("annotations"))
    doc = images.select(F.to_json(F.struct("images", notes.scalar().alias("annotations"))).alias("doc"))
    _text_file(doc, "doc", path)
    schema = "images array<struct<r_regionkey:int,r_name:string>>, annotations array<struct<image_id:int,n_nationkey:int,n_name:string>>"
    return rd.read_indexed_annotations(t.spark, path, schema).select("n_nationkey", "n_name", F.col("image.r_name").alias("r_name"))


@query("S11_directory_listing", "SELECT n AS part FROM (SELECT unnest(range(3)) AS n)")
def s11(t):
    path = scratch_path(t.spark, "listing")
    t.nation.repartition(3).write.csv(path)
    return rd.list_files(t.spark, path, "part-*").select(F.regexp_extract("name", r"part-(\d+)", 1).cast("bigint").alias("part"))


def _grey(e):
    """A pixel value from a component of a vector."""
    return F.least(F.greatest(F.floor((e.cast("double") + 1) * 128), F.lit(0)), F.lit(255)).cast("int")


def _stored_images(t) -> str:
    """The given vectors as images of 8 rows, grey, stored as PNG in containers."""
    path = scratch_path(t.spark, "images")
    hex_ = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(_grey(e)), 2, "0")), "")
    rows = t.embeddings.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), (F.size("embedding") / 8).cast("int").alias("width"), F.lit(1).alias("bands"), F.unhex(hex_).alias("pixels"))
    im.write_images(rows, path)
    return path


GREY_SQL = "least(greatest(CAST(floor((e::DOUBLE + 1) * 128) AS INTEGER), 0), 255)"


@query("S12_image_source", f"SELECT vec_id AS image_id, 8 AS width, upper(array_to_string(list_transform(embedding, lambda e: printf('%02x', {GREY_SQL})), '')) AS pixels FROM embeddings WHERE vec_id >= 40")
def s12(t):
    return im.read_images(t.spark, _stored_images(t), ("image_id", "width", "pixels")).where("image_id >= 40").select("image_id", "width", F.hex("pixels").alias("pixels"))


@query("G18_largest_red_region", f"""WITH RECURSIVE px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, embedding[i + 1] AS e, i FROM embeddings, range(64) t(i)) WHERE {GREY_SQL} > 134),
    reach AS (SELECT vec_id, y, x, y * 8 + x AS root FROM px UNION SELECT p.vec_id, p.y, p.x, r.root FROM reach r JOIN px p ON p.vec_id = r.vec_id AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
    comp AS (SELECT vec_id, y, x, min(root) AS c FROM reach GROUP BY ALL),
    box AS (SELECT vec_id, c, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM comp GROUP BY vec_id, c)
    SELECT vec_id AS image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, area FROM box WHERE area >= 3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, c) = 1""")
def g18(t):
    images = im.read_images(t.spark, _stored_images(t), ("image_id", "pixels"))
    values = F.transform(F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.substring(F.col("pixels"), i, F.lit(1))), 16, 10).cast("int"))
    rows = ra.pixel_rows(images.select("image_id", values.alias("p")), "image_id", "p", 8)
    return ra.largest_region(ra.mask_runs(rows, "image_id", "p", lambda v: v > 134), "image_id", 3)


@query("S13_in_memory_rows", "SELECT * FROM (VALUES ('cosine', 0.1::DOUBLE, 3::BIGINT), ('step', 0.3::DOUBLE, 7::BIGINT)) v(schedule, learning_rate, step)")
def s13(t):
    return t.spark.createDataFrame([("cosine", 0.1, 3), ("step", 0.3, 7)], "schedule string, learning_rate double, step bigint")


@query("S14_history_rows", "SELECT user_id, event_id, 'val_value' AS metric, value FROM events WHERE value >= 20 UNION ALL SELECT user_id, event_id, 'k', TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) FROM events")
def s14(t):
    logged = t.events.select("user_id", "event_id", F.when(F.col("value") < 20, float("nan")).otherwise(F.col("value")).alias("val/value"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")
    return rd.history_rows(logged, ["user_id", "event_id"])


@query("S15_config_flatten", "SELECT n_nationkey AS \"id\", n_name AS \"cfg.name\", n_regionkey AS \"cfg.region.key\" FROM nation")
def s15(t):
    nested = t.nation.select(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("cfg"))
    return rd.flatten_struct(nested)


@query("K1_parquet_sink", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def k1(t):
    path = scratch_path(t.spark, "sink")
    sk.write_parquet(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return t.spark.read.parquet(path)


@query("K2_csv_sink", "SELECT r_regionkey, r_name FROM region")
def k2(t):
    path = scratch_path(t.spark, "sink")
    sk.write_csv(t.region, path, one_file=True)
    return rd.read_csv(t.spark, path, "r_regionkey int, r_name string")


@query("K3_lists_as_text", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1")
def k3(t):
    return sk.lists_as_text(t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts")))


@query("K4_json_sink", "SELECT o_orderkey, o_totalprice FROM orders")
def k4(t):
    path = scratch_path(t.spark, "sink")
    sk.write_json_lines(t.orders.select("o_orderkey", "o_totalprice"), path)
    return t.spark.read.schema("o_orderkey bigint, o_totalprice double").json(path)


@query("K5_csv_rewrite", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, s_name FROM supplier")
def k5(t):
    first, second = scratch_path(t.spark, "rewrite"), scratch_path(t.spark, "rewrite")
    sk.write_csv(t.supplier.select("s_suppkey", "s_name"), first)
    renames = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000000).alias("new"))
    sk.write_csv(sk.remap_keys(rd.read_csv(t.spark, first, "s_suppkey bigint, s_name string"), renames, "s_suppkey"), second)
    return rd.read_csv(t.spark, second, "s_suppkey bigint, s_name string")


@query("K6_model_store", """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * 4096)) AS v FROM embeddings),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, floor(sum(e) / count(*)) AS m FROM (SELECT label, unnest(v) AS e, unnest(range(len(v))) AS i FROM x) GROUP BY ALL) GROUP BY label)
    SELECT vec_id, arg_min(c.label, struct_pack(d := list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c), l := c.label)) AS nearest FROM x, c GROUP BY vec_id""")
def k6(t):
    """Each label's mean vector as a model that is stored, read back and applied."""
    path = scratch_path(t.spark, "model")
    units = t.embeddings.select("label", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.floor(F.col("e").cast("double") * ml.UNITS))
    means = units.groupBy("label", "i").agg(F.floor(F.sum("e") / F.count(F.lit(1))).cast("double").alias("m"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("values"))
    mo.save_model(rows.select(F.col("label").cast("string").alias("name"), F.array(F.size("values")).alias("shape"), "values"), {"kind": "means", "units": ml.UNITS}, path)
    _, tensors = mo.load_model(t.spark, path)
    labels = sorted(map(int, tensors))
    centers = np.array([tensors[str(i)] for i in labels])
    scored = ml.with_nearest_center(t.embeddings.select("vec_id", "embedding"), "embedding", centers)
    return scored.select("vec_id", F.element_at(F.array(*map(F.lit, labels)), F.col("cluster") + 1).alias("nearest"))


@query("ST1_streamed_history", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL")
def st1(t):
    source, out, state = (scratch_path(t.spark, x) for x in ("stream", "stream-out", "stream-state"))
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).parquet(source)
    latest_into(windowed_history(stream, "ts", "event_type", "value", "1 day", "1 hour"), out, state).awaitTermination()
    last = t.spark.read.parquet(out)
    last = last.join(last.agg(F.max("epoch").alias("epoch")), "epoch", "left_semi")
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6("mean").alias("mean"), "most")


@query("K5_versioned_rewrite", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS was FROM supplier")
def k5_versioned(t):
    """Keys rewritten in place; the log of changes, of the same commit, tells what they were."""
    store = VersionedTables(t.spark, scratch_path(t.spark, "versions"))
    store.commit({"suppliers": t.supplier.select("s_suppkey", "s_name")}, "first")
    renames = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000000).alias("new"))
    rewrite_keys(store, "suppliers", renames, "s_suppkey", "even keys")
    changes = store.read("suppliers_changes").select(F.col("new").alias("s_suppkey"), F.col("old").alias("was"))
    return store.read("suppliers").join(changes, "s_suppkey", "left").select("s_suppkey", "s_name", "was")


@query("U7_versioned_append", "SELECT o_orderkey, 2 AS version FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 1000) UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F'")
def u7_versioned(t):
    """Validated new rows appended as a new version, and the version before it."""
    store = VersionedTables(t.spark, scratch_path(t.spark, "versions"))
    store.commit({"orders": t.orders.where("o_orderstatus = 'F'").select("o_orderkey")}, "first")
    there = store.read("orders")
    new = t.orders.where("o_orderstatus = 'O' and o_totalprice > 1000").select("o_orderkey")
    store.commit({"orders": there.unionByName(rel.absent(new, there, {"o_orderkey": "o_orderkey"}))}, "more")
    both = [store.read("orders", n).select("o_orderkey", F.lit(n).alias("version")) for n in (1, 2)]
    return both[0].unionByName(both[1])


@query("Q15_rolled_back_table", "SELECT s_suppkey, s_name, 3 AS version, 1 AS restored FROM supplier")
def q15_versioned(t):
    """A rewrite undone: the rows of the first version are the last one's."""
    store = VersionedTables(t.spark, scratch_path(t.spark, "versions"))
    store.commit({"suppliers": t.supplier.select("s_suppkey", "s_name")}, "first")
    rewrite_keys(store, "suppliers", t.supplier.select(F.col("s_suppkey").alias("old"), (-F.col("s_suppkey")).alias("new")), "s_suppkey", "wrong")
    done = store.rollback(1)
    return store.read("suppliers").select("s_suppkey", "s_name", F.lit(done.number).alias("version"), F.lit(done.restored).alias("restored"))


@query("S10_first_existing_path", "SELECT place, candidate, place > 1 AS there, place = 2 AS chosen, CASE WHEN place = 2 THEN (SELECT count(*) FROM region) END AS n FROM (VALUES (1, 'no_such.parquet'), (2, 'region.parquet'), (3, 'nation.parquet')) v(place, candidate)")
def s10(t):
    """Which of three candidates is there, which is chosen, and how many rows it has."""
    names = ["no_such.parquet", "region.parquet", "nation.parquet"]
    found = rd.candidate_paths(t.spark, [f"{t.root}/{n}" for n in names])
    n = t.spark.read.parquet(rd.first_existing(t.spark, [f"{t.root}/{x}" for x in names])).agg(F.count(F.lit(1)).alias("n"))
    rows = found.select("place", F.element_at(F.split("candidate", "/"), -1).alias("candidate"), "there", "chosen")
    return rows.withColumn("n", F.when(F.col("chosen"), n.scalar()))


@query("Q1_required_columns", "SELECT * FROM (VALUES ('supplier', 's_score'), ('nation', 'n_area')) v(table_name, missing)")
def q1(t):
    need = {"supplier": ["s_suppkey", "s_score", "s_acctbal"], "nation": ["n_name", "n_area"]}
    parts = [rd.missing_columns(getattr(t, name), columns).select(F.lit(name).alias("table_name"), "missing") for name, columns in need.items()]
    return parts[0].unionByName(parts[1])


@query("Q12_required_rows", "SELECT n_nationkey AS nation FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def q12(t):
    """The nations for which a filter leaves no supplier."""
    return qa.keys_without_rows(t.nation.select(F.col("n_nationkey").alias("nation")), qa.require_rows(t.supplier, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation")), "nation")
