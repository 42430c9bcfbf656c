"""The numbered queries of this subpackage and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chat_threads, decontamination, fill_in_middle, html_extraction, jaccard_join, language_id, language_model, merkle_manifest, mixing, quality_classifier, quality_rules, sharding, token_files
from corpusmill.llm._scratch import new_path
from corpusmill.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_thread_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_threads.thread(_table(spark, sf_dir, "conversations"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_text_links", "class_size")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens-orc")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, added_tokens=True)
    return token_files.describe_tokens(spark, path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    others = [F.col(c) for c in merkle_manifest.COLUMNS[:-1]]
    # What a reader finds where someone has deleted the line breaks of half of the documents.
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle_manifest.leaf_digest(*others, F.translate("text", "\n", "")))
    rows = merkle_manifest.manifest(docs, carry={"found": found})
    rows = rows.withColumn("folded_root", merkle_manifest.folded(F.coalesce("found", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix_sources, op2_extract_html, op3_decontaminate, op4_language_id, op5_quality_classifier, op6_thread_chats, op7_shard, op8_jaccard_join, op9_quality_rules,
        op10_token_files, op11_fill_in_middle, op12_merkle_manifest, op13_language_model,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
