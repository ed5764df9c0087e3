"""Merkle manifest of a dataset: blocks of leaves reduced by tasks, a small top tree built by the driver, its paths broadcast, proofs and folds by tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dealt_join, few, narrow_join, written

#: Children of a node; levels of a block (a block has WIDTH ** DEPTH nodes at most); nodes that the driver may hold; groups that may be broadcast.
WIDTH, DEPTH, TOP_NODES, FEW_GROUPS = 8, 3, 4096, 100_000
BLOCK = WIDTH**DEPTH

Path = list[tuple[str, str]]


def joined(parts: list[str]) -> str:
    """The node over some nodes: lowercase hex SHA-256 of their hex texts."""
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The nodes and each level over them, until one node remains or `most` levels are made."""
    out = [nodes]
    while len(out[-1]) > 1 and (most is None or len(out) <= most):
        last = out[-1]
        out.append([joined(last[i : i + WIDTH]) for i in range(0, len(last), WIDTH)])
    return out


def block_levels(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of one block of a group of n nodes; the last block of a large group rises as far as the others, by runs of one node if need be."""
    if n <= BLOCK:
        return levels(nodes)
    out = [nodes]
    for _ in range(DEPTH):
        out.append([joined(out[-1][i : i + WIDTH]) for i in range(0, len(out[-1]), WIDTH)])
    return out


def path(made: list[list[str]], i: int) -> Path:
    """What stands before and after node i in its run, level by level."""
    out = []
    for nodes in made[:-1]:
        at = i // WIDTH * WIDTH
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + WIDTH])))
        i //= WIDTH
    return out


def folded(node: str, steps: Path) -> str:
    """The root that follows from a node and its path."""
    for before, after in steps:
        node = sha256(f"{before}{node}{after}".encode()).hexdigest()
    return node


def _hex(nodes: bytes) -> list[str]:
    return [nodes[i : i + 32].hex() for i in range(0, len(nodes), 32)]


def _placed(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """Adds place: the row's number from 0 in the whole order. A written table fixes which row is in which partition."""
    tied = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [*order, F.col("_tie")]
    dealt = written(tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "merkle-rows")
    part = F.shiftright("_id", 33)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_id")


def _packed(nodes: DataFrame, carried: bool) -> DataFrame:
    """One row a block: start (the group), n (its nodes), block (place among the group's), nodes (32 bytes each), node (the block's own).

    nodes has start, n, pos, node (binary); with `carried` also doc_id and other (binary, null if alike), packed as doc_ids and others.
    """
    schema = "start long, n long, block long, nodes binary, node binary" + (", doc_ids array<long>, others array<binary>" if carried else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            start, n, pos = (rows.column(c)[0].as_py() for c in ("start", "n", "pos"))
            each = rows.column("node").to_pylist()
            root = bytes.fromhex(block_levels([x.hex() for x in each], n)[-1][0])
            out = [pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([pos // BLOCK], pa.int64()), pa.array([b"".join(each)], pa.binary()), pa.array([root], pa.binary())]
            if carried:
                out += [pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([rows.column("other").to_pylist()], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            start, block = batch.column("start").to_numpy(), batch.column("pos").to_numpy() // BLOCK
            cut = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (block[1:] != block[:-1])) + 1), batch.num_rows]
            for s, e in zip(cut, cut[1:], strict=False):
                key = (start[s], block[s])
                if held and key != last:
                    yield close(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = key
        if held:
            yield close(held)

    keyed = nodes.withColumn("_first", F.col("start") + F.expr(f"pos div {BLOCK}") * BLOCK)  # the place of the block's first node: no two blocks share it
    columns = ["start", "n", "pos", "node", *(["doc_id", "other"] if carried else [])]
    dealt = keyed.repartition("_first").sortWithinPartitions("_first", "pos").select(*columns)
    return written(dealt.mapInArrow(run, schema), "merkle-blocks")


def _above(blocks: DataFrame) -> DataFrame:
    """The blocks' own nodes as the next level."""
    return blocks.select("start", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("pos"), "node")


_PATHS = "start long, block long, befores array<string>, afters array<string>, subroot string, root string"


def _top(nodes: DataFrame) -> DataFrame:
    """Paths (see _PATHS) of at most TOP_NODES nodes, from the trees over them that the driver builds: one for each group, one over the groups' roots."""
    rows = nodes.orderBy("start", "pos").select("start", "pos", "node").collect()
    groups: dict[int, list[str]] = {}
    for r in rows:
        groups.setdefault(r.start, []).append(bytes(r.node).hex())
    made = {start: levels(x) for start, x in groups.items()}
    top = levels([x[-1][0] for x in made.values()])
    out = []
    for k, (start, own) in enumerate(made.items()):
        upper = path(top, k)
        for i in range(len(own[0])):
            steps = path(own, i) + upper
            out.append((start, i, [b for b, _ in steps], [a for _, a in steps], own[-1][0], top[-1][0]))
    return nodes.sparkSession.createDataFrame(out, _PATHS)


def _carried_down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of all nodes of the blocks, from those of the blocks' own nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                made = block_levels(_hex(r["nodes"]), r["n"])
                out = [(r["start"], r["block"] * BLOCK + j, path(made, j)) for j in range(len(made[0]))]
                columns = [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([[b for b, _ in x[2]] + r["befores"] for x in out], pa.list_(pa.string())),
                    pa.array([[a for _, a in x[2]] + r["afters"] for x in out], pa.list_(pa.string())),
                    pa.array([r["subroot"]] * len(out), pa.string()),
                    pa.array([r["root"]] * len(out), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["start", "block", "befores", "afters", "subroot", "root"])

    return written(_with_paths(blocks.select("start", "n", "block", "nodes"), paths).mapInArrow(run, _PATHS), "merkle-paths")


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """A path has a few KB, so only as many as the driver may hold are broadcast."""
    return narrow_join(blocks, paths, ["start", "block"], most=TOP_NODES)


def _paths(nodes: DataFrame, parts: int) -> DataFrame:
    """Paths of all nodes of a level: reduced by blocks until the driver can hold what is left, then carried down again."""
    made: list[DataFrame] = []
    while not few(nodes, TOP_NODES):
        if not nodes.where("n > 1").limit(1).count():  # many groups: their roots are the nodes of one tree
            ranked = written(_placed(nodes.select("start", "node"), [F.col("start")], parts), "merkle-roots")
            one = ranked.select(F.lit(0).cast("long").alias("start"), F.lit(ranked.count()).cast("long").alias("n"), F.col("place").alias("pos"), "node")
            over = _paths(one, parts).withColumnRenamed("block", "place").drop("start", "subroot")
            paths = ranked.join(over, "place").select("start", F.lit(0).cast("long").alias("block"), "befores", "afters", F.lower(F.hex("node")).alias("subroot"), "root")
            break
        made.append(_packed(nodes, carried=False))
        nodes = _above(made[-1])
    else:
        paths = _top(nodes)
    for blocks in reversed(made):
        paths = _carried_down(blocks, paths)
    return paths


def manifest(rows: DataFrame, parts: int | None = None, steps: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and with `steps` befores and afters: the siblings, level by level) of rows that have
    doc_id (integer), grp (string), leaf and other (binary digests).

    Leaves of one grp ascend by doc_id (null first), then by leaf; every eight nodes become one until a group's root remains, and the groups' roots, in
    order of grp (null first, bytewise), likewise become the root. folded_root is what `other` (the leaf itself where null) gives with the leaf's siblings.

    Only ids and digests are shuffled: once into the order (range partitions, rows alike spread), once into blocks of 512 leaves. A group that holds most
    rows is many blocks; many groups are ranked and reduced like leaves. Rows alike are interchangeable. Without rows the result is empty.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A null group sorts before all others, and joins.
    keyed = rows.select("doc_id", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")).alias("g"), "leaf", "other")
    placed = written(_placed(keyed, [F.col("g"), F.col("doc_id"), F.col("leaf")], parts), "merkle-leaves")
    groups = written(placed.groupBy("g").agg(F.min("place").alias("start"), F.count("*").alias("n")).withColumn("size", F.col("n")), "merkle-groups")
    if few(groups, FEW_GROUPS):
        told = placed.join(F.broadcast(groups.drop("size")), "g")
    else:
        told = dealt_join(placed, groups, "g", ["place"]).withColumnRenamed("size", "n")
    blocks = _packed(told.select("start", "n", (F.col("place") - F.col("start")).alias("pos"), F.col("leaf").alias("node"), "doc_id", "other"), carried=True)
    found = _with_paths(blocks.drop("node"), _paths(_above(blocks), parts))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", befores array<string>, afters array<string>" if steps else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                made = block_levels(_hex(r["nodes"]), r["n"])
                upper = list(zip(r["befores"], r["afters"], strict=True))
                ways = [path(made, j) + upper for j in range(len(made[0]))]
                proofs = [sha256("".join(x for step in way for x in step).encode()).hexdigest() for way in ways]
                ends = [folded(leaf if other is None else other.hex(), way) for leaf, other, way in zip(made[0], r["others"], ways, strict=True)]
                n = len(ways)
                columns = [pa.array(r["doc_ids"], pa.int64()), *(pa.array(x, pa.string()) for x in (made[0], [r["subroot"]] * n, [r["root"]] * n, proofs, ends)), pa.array([x == r["root"] for x in ends], pa.bool_())]
                if steps:
                    columns += [pa.array([[step[k] for step in way] for way in ways], pa.list_(pa.string())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return found.mapInArrow(run, schema)


def _stated(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def document_manifest(docs: DataFrame, steps: bool = False) -> DataFrame:
    """The manifest of documents: a leaf states doc_id, source, lang, n_chars and text; groups are languages.

    Tampering, to show that folds fail: where 3 divides the CRC-32 of the decimal doc_id, A-Z of the text become lower case; null ids and texts stay.
    Columns beside these are not used. Empty and very long texts are hashed whole, where they are read.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.col("text")
    leaf = lambda t: F.unhex(F.sha2(F.concat(*(_stated(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _stated(t)).cast("binary"), 256))
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & text.rlike("[A-Z]")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("grp"), leaf(text).alias("leaf"), F.when(touched, leaf(F.translate(text, upper, lower))).alias("other"))
    return manifest(slim, steps=steps)
