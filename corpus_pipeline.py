"""From raw documents to training shards: quality, near duplicates, benchmark passages, source mix, byte shards.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns; the last one adds shard and slot. run() writes
every stage's rows to the shared folder and reads them again, so a lost executor costs a stage at most; a stage's other tables are deleted with its end,
and its input once its own rows are written, so that two corpora are there at most.

In every stage empty tables give empty ones, further columns pass under their names, a null text counts as empty, repeated rows are documents of their own (but
that the second keeps one of them), and very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewell.llm import decontam, minhash, mixing, quality, sharding
from pricewell.llm.common import written
from pricewell.scratch import discard, newest, swept

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject as low quality or toxic. Repeated rows share their fate; without labels all stay."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that shares 0.8 of its 5-word shingles; of rows alike one. Null, empty and blank texts all stay."""
    return minhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 10 consecutive words of a benchmark item (or the whole of a shorter one). Null and empty texts stay, repeated rows share their fate."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is one of its own; rows alike are taken one by one."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot: contiguous shards of near equal bytes. A null doc_id comes first, rows alike may lie in several shards."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, MinHash and the suffix arrays have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, consumed = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with swept(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if consumed:
            discard(spark, consumed)
        consumed = newest()
    return docs
