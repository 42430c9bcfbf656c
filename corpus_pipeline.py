"""From raw documents to shards: good documents, one of each near-duplicate group, free of benchmark passages, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. run() writes each stage in the shared folder and hands it to the next one; what a stage needed is deleted then.

Null and empty texts have no words: they are kept or rejected by their score, are no near-duplicates of each other, hold no
benchmark window, and the mix takes none of them. Rows with a null id are documents like others, rows that repeat an id or a
text are near-duplicates or different documents by their texts. Texts of any length are worked on whole. Other columns, of any
name, come through up to the last stage. Empty documents give an empty result; without labels all scores are 0.5, so none pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, jaccard_join, mixing, quality_classifier, sharding
from corpusmill.llm._scratch import cut, drop, drop_since, mark

SHARDS = 8
LEAST_WEIGHT = 0.01


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7; the model is fitted on labelled documents outside the held-out fold."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each near-duplicate class."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: zero, one or two rows. A document weighs its quality score, by the
    first stage's model."""
    model = quality_classifier.fit_from(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.add_scores(docs.select("doc_id", "text", "source"), model, "score")
    return mixing.repeated(docs, mixing.mix(scored, boundary="nearest", weight=F.greatest(F.lit(LEAST_WEIGHT), F.col("score"))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of the mix."""
    return sharding.assign_shards(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: A fitted classifier is not expressible in SQL; the pipeline is tested against a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, made = docs, mark()
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
        drop_since(spark, made, docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
