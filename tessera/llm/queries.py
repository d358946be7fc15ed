"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, clustering, decontaminate, licenses, mixing, passages, quality, sharding, simhash, tokens, topk, toxicity, urls
from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("offsets")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % topk.EVERY == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_license_scan, op4_toxicity, op5_kd_shards, op6_simhash_near_dedup, op7_quality_rules, op8_url_filter, op9_token_blocks, op10_passage_dedup, op11_align_tokenizers, op12_centroid_clusters, op13_exact_topk)}
ORACLES: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op2_decontaminate": decontaminate.ORACLE, "op3_license_scan": licenses.ORACLE, "op8_url_filter": urls.ORACLE, "op12_centroid_clusters": clustering.ORACLE, "op13_exact_topk": topk.ORACLE}
