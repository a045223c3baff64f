"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from salesgrid.llm import (
    fim, language, licenses, mixing, near_dedup, packing, pii, quality, sharding, topk, toxicity, trie, vector_dedup,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, folder, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search_embeddings(_table(spark, folder, "embeddings"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_documents(_table(spark, folder, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, folder, "embeddings"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, folder, "conversations"))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan_documents(_table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.transform_documents(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_sharding, op3_packing, op4_license_scans, op5_minhash_near_dedup, op6_exact_top_k,
        op7_quality_classifier, op8_mixing, op9_language_id, op10_embedding_near_dedup,
        op11_prefix_trie, op12_pii, op13_fill_in_middle,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op6_exact_top_k": topk.ORACLE, "op8_mixing": mixing.ORACLE, "op11_prefix_trie": trie.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
