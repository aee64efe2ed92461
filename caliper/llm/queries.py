"""The thin queries of the driver contract, one opN_<name> for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm import audio, codes, html_text, langid, oracles, privacy, quality, token_spans, trie
from caliper.llm.ann import nearest
from caliper.llm.mixing import mix
from caliper.llm.near_dedup import near_duplicates
from caliper.llm.packing import pack
from caliper.llm.sharding import assign_shards, uniform_tree, with_slots
from caliper.llm.words import word_count


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clips = audio.with_features(audio.to_clips(docs))
    spoken = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + s["end_s"] - s["start_s"])
    feature = F.concat_ws(":", F.sha2("features", 256), F.size("segments").cast("string"), F.round(spoken, 3).cast("string"))
    return clips.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, word_count(F.col("text")), cut=True)
    taken = F.least(F.rint(F.col("copies") * F.col("size")).cast("long"), 2 * F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "copies")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_count(F.col("text")))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    digest = docs.select("doc_id", size.alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))
    now = assign_shards(digest, "doc_id", uniform_tree(24))
    grown = assign_shards(now, "doc_id", uniform_tree(25), "__g", "__k", "grown_shard").drop("__g", "__k")
    slotted = with_slots(grown, "shard", "doc_id")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def op5_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = quality.scored(docs, quality.fit(docs, ratings, n_grades=3))
    good, clean = F.col("tails")[0], F.col("tails")[1]
    return scores.select("doc_id", "expected_grade", good.alias("p_good"), clean.alias("p_clean"), "kept")


def op7_line_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.predicted(docs, langid.fit_on_folds(docs))
    held_out = (langid.fold(F.col("doc_id")) == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), rule="most")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.prefix_trie(trie.with_shared_heads(trie.conversations_of(turns)))


def op12_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = codes.with_label_error(coded.rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(coded.books.digest()).alias("codebooks_sha256"))


def op13_information_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = privacy.protected(docs, privacy.revealing_terms(docs), with_text=False)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in privacy.KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*privacy.KINDS))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_hash_tree_shards": op4_hash_tree_shards,
    "op5_stable_projection_ann": op5_stable_projection_ann,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_line_block_html": op7_line_block_html,
    "op8_kneser_ney_langid": op8_kneser_ney_langid,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_section_tokens": op10_section_tokens,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_heap_lloyd_codes": op12_heap_lloyd_codes,
    "op13_information_sanitiser": op13_information_sanitiser,
}

#: The other operators train models, draw or pack: they are tested against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {
    "op4_hash_tree_shards": oracles.hash_tree_shards(),
    "op7_line_block_html": oracles.LINE_BLOCK_HTML,
    "op9_minhash_dedup": oracles.MINHASH_DEDUP,
    "op11_conversation_trie": oracles.CONVERSATION_TRIE,
    "op12_heap_lloyd_codes": oracles.heap_lloyd_codes(),
}
