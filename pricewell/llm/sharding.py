"""Contiguous shards of near equal bytes, from per-partition totals and one prefix sum over the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import masked, written


def byte_shards(rows: DataFrame, order: list[str], size: str, shards: int, parts: int | None = None) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (place in the shard, from 0) to slim rows.

    Rows are range-partitioned by `order`, each partition sums its sizes, the prefix sum over the partitions' totals gives each
    partition its offset, and a row belongs to the shard in whose equal share of all bytes its middle byte lies. A shard differs
    from the equal share by less than one row at either end. Nulls sort first; rows alike in all of `order` are interchangeable and are spread by a hash
    of their place in the input, so that a third of all rows may be alike. Size must be positive and not null. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The written table fixes which row is in which partition: a repeated task can't deal them differently.
    order = [*order, "_tie"]
    tied = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = written(tied.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "shard-rows")
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(W.partitionBy(F.lit(0))).alias("_total"),
    )  # one row a partition: its size is set by `parts`
    inside = W.partitionBy("_part").orderBy(*order)
    upto = F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = (
        dealt.withColumn("_upto", upto)
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn("shard", _share(F.col("_bytes0") + F.col("_upto") - F.col(size), F.col(size), F.col("_total"), shards))
        .withColumn("_global", F.col("_rows0") + F.col("_row") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("_global").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_global") - F.col("_first")).drop("_part", "_tie", "_upto", "_row", "_bytes0", "_rows0", "_total", "_global", "_first")


def _share(before: Column, size: Column, total: Column, shards: int) -> Column:
    middle = before * 2 + size  # in half bytes
    return F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (total * 2))).cast("int")


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32, law, shard, slot, grown_shard; in order of doc_id, then text.

    Null text counts as empty (size 1, CRC 0); a null doc_id comes first. Columns beside doc_id and text are not used, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return byte_shards(slim, ["doc_id", "text_crc32", "size"], "size", shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def place(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All rows and columns of the documents with shard and slot. Here the rows themselves are dealt, so rows of one doc_id need no join."""
    docs = docs.drop("shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = masked(docs, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    placed = byte_shards(rows, ["doc_id", "crc", "size"], "size", shards)
    return placed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), "shard", F.col("slot").cast("long").alias("slot"))
