"""The operators as registered queries, each over its whole table; oracle() holds SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embedding, hardneg, linededup, media, merkle, minhash, mixing, oracles, quality, sharding, substring, suffixdedup, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_table(spark, sf_dir, "documents"))


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.page_lines(_table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.document_groups(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.document_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.document_suffixes(_table(spark, sf_dir, "documents"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.document_windows(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.embedding_negatives(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (
        op1_media_chunks,
        op2_site_lines,
        op3_near_duplicates,
        op4_mix_sources,
        op5_decontaminate,
        op6_suffix_dedup,
        op7_byte_shards,
        op8_substring_dedup,
        op9_quality,
        op10_count_tokens,
        op11_near_vectors,
        op12_hard_negatives,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in own}


def oracle() -> dict[str, str]:
    return dict(oracles.ORACLES)
