"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import (
    alignment,
    extraction,
    linededup,
    merkle,
    mixing,
    neardup,
    packing,
    pii,
    quality,
    scoring,
    sharding,
    topk,
    toxicity,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_source_mixing(spark, folder):
    return mixing.mixed_rows(_table(spark, folder, "documents"))


def op2_minhash_near_duplicates(spark, folder):
    return neardup.near_duplicates(_table(spark, folder, "documents"), words=3, similar=85)


def op3_stratified_shards(spark, folder):
    shards = sharding.interleaved_shards(_table(spark, folder, "documents"))
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_surrogate_entities(spark, folder):
    return pii.replaced_documents(_table(spark, folder, "documents"))


def op5_robust_outliers(spark, folder):
    return quality.quality_verdicts(_table(spark, folder, "documents"))


def op6_attention_scores(spark, folder):
    return scoring.language_scores(_table(spark, folder, "documents"))


def op7_counterfactual_toxicity(spark, folder):
    return toxicity.scored_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_exact_top_scores(spark, folder):
    return topk.top_scores(_table(spark, folder, "embeddings"))


def op9_best_fit_packing(spark, folder):
    return packing.packed_pieces(_table(spark, folder, "documents"))


def op10_main_text(spark, folder):
    return extraction.page_texts(_table(spark, folder, "pages"))


def op11_token_alignment(spark, folder):
    return alignment.aligned_tokens(_table(spark, folder, "documents"))


def op12_shared_lines(spark, folder):
    return linededup.line_digests(_table(spark, folder, "documents"))


def op13_merkle_manifest(spark, folder):
    return merkle.verified_documents(_table(spark, folder, "documents"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_minhash_near_duplicates": op2_minhash_near_duplicates,
    "op3_stratified_shards": op3_stratified_shards,
    "op4_surrogate_entities": op4_surrogate_entities,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_attention_scores": op6_attention_scores,
    "op7_counterfactual_toxicity": op7_counterfactual_toxicity,
    "op8_exact_top_scores": op8_exact_top_scores,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_main_text": op10_main_text,
    "op11_token_alignment": op11_token_alignment,
    "op12_shared_lines": op12_shared_lines,
    "op13_merkle_manifest": op13_merkle_manifest,
}
