"""The corpus pipeline: named stages, each one of the training-data operators on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it. All but the last
return the columns of documents, whatever else docs holds under other names, so that names of the operators never clash.
No documents give no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm import langid, quality
from caliper.llm.mixing import mix
from caliper.llm.near_dedup import drop_near_duplicates
from caliper.llm.packing import pack
from caliper.sources.scratch import written
from caliper.llm.words import word_count


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go. Null and empty texts are judged as the empty text, equal texts alike; labels
    with nulls are left out. Without labels the model tells nothing and all stay."""
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.selected(docs, quality.fit(docs, ratings, n_grades=3))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go, as do null texts and those without a letter; equal texts go or
    stay together. Without labelled texts no language is learned and all go."""
    return langid.accepted(docs, langid.fit_on_folds(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8. Of rows that repeat a doc_id one
    stays; rows with a null doc_id and texts without words are nobody's duplicates."""
    return drop_near_duplicates(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; whole copies only. Null sources are one source, null ids of a source
    one unit; documents without words are not taken; rows that repeat a (doc_id, source) are taken equally often."""
    mixed = mix(docs, word_count(F.col("text")))
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("copies").cast("int").alias("__copies")).distinct()
    same = docs["doc_id"].eqNullSafe(copies["__id"]) & docs["source"].eqNullSafe(copies["__source"])
    taken = docs.where(word_count(F.col("text")) > 0).join(copies, same)
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, counted in words, in training sequences. A text without words has a row without a bin."""
    return pack(docs, word_count(F.col("text")))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("near-duplicates", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models, MinHash and seeded draws have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
