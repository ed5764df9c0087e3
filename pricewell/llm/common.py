"""Spark helpers shared by the operators: checked broadcasts, text batches, columns of any name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import shared_dir, written

__all__ = ["blocks", "dealt_join", "few", "masked", "narrow_join", "shared_dir", "text_bytes", "unmasked", "utf8", "written"]

#: Rows of a few numbers that may be broadcast; with more, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that meet in a task at least before its rows are dealt to several tasks; keys that may be told as hot at most; and rows of a table
#: of a few numbers that is so small that it doesn't matter.
GROUP_ROWS, HOT_KEYS, SMALL_ROWS = 512, 100_000, 200_000
#: Text bytes that a kernel handles at once, some less than 1 MB; one longer document is a block of its own.
BLOCK_BYTES = 900_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """True if a written table has at most so many rows."""
    return df.count() <= most


def narrow_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a written table of narrow rows: by broadcast if its counted rows fit, else by a shuffle of both sides."""
    return left.join(F.broadcast(right) if few(right, most) else right, on, how)


def dealt_join(left: DataFrame, right: DataFrame, on: str, place: list[str], how: str = "inner", total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Joins right (one row a key, with `n`, the key's rows in left) to left where single keys may hold a large share of left's rows.

    Keys of more than GROUP_ROWS rows, and of more than a HOT_KEYS-th of all rows, are dealt by a hash of `place` to as many tasks as they hold
    such portions; right's row goes to each of them. At most HOT_KEYS keys can be so frequent, so their table is broadcast. `n` is not kept.
    `total` is the number of left's rows if these are a few numbers each: with SMALL_ROWS or less nothing is dealt. `counts` (key and n, a written
    table) stands for right's `n` where right has long rows. Null keys match nothing; left rows that have one must not be many in a left join.
    """
    if total is not None and total <= min(SMALL_ROWS, 400 * GROUP_ROWS):
        return left.join(right.drop("n"), on, how)
    if counts is None:
        right = counts = written(right, "dealt")
    seen = counts.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    most = max(GROUP_ROWS, (seen.rows or 0) // HOT_KEYS)
    if (seen.most or 0) <= most:
        return left.join(right.drop("n"), on, how)
    hot = written(counts.where(F.col("n") > most).select(on, F.ceil(F.col("n") / most).cast("int").alias("_portions")), "dealt-hot")
    put = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*place), F.col("_portions")), F.lit(0)).cast("int")).drop("_portions")
    each = right.drop("n").join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_portions", F.lit(1)) - 1))).drop("_portions")
    return put.join(each, [on, "_salt"], how).drop("_salt")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `most` bytes of text, and the texts; only one slice's texts are Python objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        at, size = 0, 0
        for i, n in enumerate(sizes):
            size += n + 1
            if size >= most or i + 1 == len(sizes):
                part = batch.slice(at, i + 1 - at)
                yield part, text_bytes(part.column(text))
                at, size = i + 1, 0


def utf8(text: str | Column = "text") -> Column:
    """The text's bytes; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def masked(docs: DataFrame, *needed: str | Column) -> DataFrame:
    """The columns as c0, c1, ... and the needed ones again under their own names, so that no name of the documents' clashes with an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), *needed)


def unmasked(rows: DataFrame, names: list[str], **own: str) -> DataFrame:
    """The columns c0, c1, ... under their names again; own: names of columns that stand in for one of them."""
    return rows.select(*(F.col(own.get(c, f"c{i}")).alias(c) for i, c in enumerate(names)))
