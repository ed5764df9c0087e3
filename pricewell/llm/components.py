"""Connected components of a link table by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, written

#: Links that a task joins by itself before the rounds; what it holds at once is bounded by this.
BLOCK_LINKS = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of links as stars: every node of it but the least of a component points to that one."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for b in held:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                a, c = top(u), top(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        ends = [(x, top(x)) for x in list(parent)]
        ends = np.array([e for e in ends if e[0] != e[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_LINKS):
            part = batch.slice(at, BLOCK_LINKS)
            if size + part.num_rows > BLOCK_LINKS:
                yield stars(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if held:
        yield stars(held)


def _settled(edges: DataFrame) -> bool:
    """True if the edges are stars: no node points to two others, or is pointed to and points elsewhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
    return not open_.limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the links (u, v); nodes without links are absent.

    Tasks first join the links of their blocks; then each round points neighbours at the least one they know, until the edges (from the greater
    node to the lesser) are stars. The number of rounds grows with the logarithm of a chain's length in blocks. The joins that hand out the minima
    deal a star of many rays to several tasks. Loops and repeated links are allowed.
    """
    own = written(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v"), "cc")
    edges = written(own.coalesce(max(1, -(-own.count() // BLOCK_LINKS))).mapInArrow(_contracted, "u long, v long"), "cc")
    total = edges.count()
    while not _settled(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = dealt_join(both.where("v > u"), low, "u", ["v"], total=total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(large, "cc")
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = dealt_join(edges, low, "u", ["v"], total=total).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v")
        edges = written(small.distinct(), "cc")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
