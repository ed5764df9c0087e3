"""Finite automata over ordered rows: a chunk of rows is a map of states, maps compose along a group, chunks replay from the state they begin in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def states(rows: DataFrame, token: Column, table: Sequence[Sequence[int]], group: Sequence[str] = ("documento",), order: str = "linea", chunk: int = 256) -> DataFrame:
    """Adds antes and despues, the state before and after each row; a group begins in state 0 and table[state][token] is the next one.

    No task holds a group's rows: chunks of `chunk` rows become maps of states, and only these (one a chunk) meet, to tell the state in which each chunk begins.
    """
    width, flat = len(table[0]), F.array(*(F.lit(s) for line in table for s in line))
    step = lambda s, t: F.element_at(flat, s * width + t + 1)
    keys, columns = list(group), rows.columns
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    numbered = rows.withColumn("_t", token).withColumn("_k", place).withColumn("_c", F.floor(F.col("_k") / chunk))
    packed = numbered.groupBy(*keys, "_c").agg(F.sort_array(F.collect_list(F.struct("_k", "_t", *columns))).alias("_rows"))
    start = F.array(*(F.lit(s) for s in range(len(table))))
    packed = packed.withColumn("_map", F.aggregate("_rows", start, lambda m, r: F.transform(m, lambda s: step(s, r["_t"]))))
    begun = F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<struct<c: bigint, s: int>>)").alias("out"))
    along = F.aggregate(
        F.sort_array(F.collect_list(F.struct("_c", "_map"))), begun,
        lambda a, c: F.struct(F.element_at(c["_map"], a["s"] + 1).alias("s"), F.concat(a["out"], F.array(F.struct(c["_c"].alias("c"), a["s"].alias("s")))).alias("out")),
        lambda a: a["out"],
    )
    starts = packed.groupBy(*keys).agg(along.alias("_s")).select(*keys, F.inline("_s")).select(*keys, F.col("c").alias("_c"), F.col("s").alias("_start"))
    replay = F.aggregate(
        "_rows", F.struct(F.col("_start").alias("s"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda a, r: F.struct(step(a["s"], r["_t"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")),
        lambda a: a["out"],
    )
    both = packed.join(starts, [*keys, "_c"]).withColumn("_antes", replay).select(F.explode(F.arrays_zip("_rows", "_antes")).alias("r"))
    flatly = both.select(*(F.col(f"r._rows.`{c}`").alias(c) for c in columns), F.col("r._antes").alias("antes"), F.col("r._rows._t").alias("_t"))
    return flatly.withColumn("despues", step(F.col("antes"), F.col("_t"))).drop("_t")
