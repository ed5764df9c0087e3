"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import kernels as K
from .common import dealt_join, written
from .components import components

SEED = 20240611
#: Rows of whole units that a task compares at once, and members of a unit up to which it is compared together with others.
HELD_ROWS, SMALL_UNIT = 8192, 16
#: Least and greatest size of the blocks in which a family or a crowded bucket is compared.
LEAST_BLOCK, MOST_BLOCK = 128, 4096
#: The vec_id of rows without one, after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Spec:
    """Pairs of a cosine of `cosine` or more. A pair just at it shares no bucket with a chance of `miss` at most; nearer pairs share more buckets.

    `bits` hyperplanes sign a bucket's key. `fitted` sets them to the logarithm of the number of vectors and three more, so that vectors that are not
    alike share a bucket as rarely in a large table as in a small one; `tables` follows from bits and miss. Buckets of more than `hot` members are
    crowded by vectors that are alike: those that share members are a family, if it has at most `spread` times the members of its largest bucket.
    """

    cosine: float = 0.95
    miss: float = 1e-3
    bits: int = 12
    hot: int = 256
    spread: int = 8

    def fitted(self, vectors: int) -> Spec:
        return replace(self, bits=max(8, vectors.bit_length() + 3))

    @property
    def tables(self) -> int:
        shared = (1 - acos(self.cosine) / pi) ** self.bits
        return ceil(log(self.miss) / log(1 - shared))


@lru_cache(maxsize=4)
def planes(dim: int, n: int) -> np.ndarray:
    """n hyperplanes through the origin, the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((n, dim)).T


def keys(spec: Spec, unit: np.ndarray) -> np.ndarray:
    """A bucket a table for each row of unit vectors; buckets of different tables and dimensions differ."""
    out = np.empty((len(unit), spec.tables), np.uint64)
    weights = np.uint64(1) << np.arange(spec.bits, dtype=np.uint64) % np.uint64(64)
    start = K.mix(np.arange(spec.tables, dtype=np.uint64) * K.U(K.P) + K.U(unit.shape[1]))
    for at in range(0, len(unit), 1024):
        side = (unit[at : at + 1024] @ planes(unit.shape[1], spec.tables * spec.bits) >= 0).reshape(-1, spec.tables, spec.bits)
        out[at : at + 1024] = K.mix(start + (side * weights).sum(axis=2, dtype=np.uint64) * K.U(K.P))
    return out.view(np.int64)


def directions(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, of vectors of one dimension; a vector's scale can't make its norm overflow."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dimension(vectors: list[bytes]) -> Iterator[np.ndarray]:
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _sound(rows: DataFrame, kind: str) -> DataFrame:
    """row, vec_id, digest and vector (its bytes); the last two are null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes | None] = []
            for x in batch.column("vector"):
                v = x.values
                ok = v is not None and len(v) and not v.null_count
                v = v.to_numpy(zero_copy_only=False).astype(kind) + 0.0 if ok else None  # -0.0 becomes 0.0
                found.append(v.tobytes() if ok and np.isfinite(v).all() and v.any() else None)
            digest = [K.digest(x) if x is not None else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(found, pa.binary())], names=["row", "vec_id", "digest", "vector"])

    return rows.mapInArrow(run, "row long, vec_id long, digest binary, vector binary")


def _buckets(nodes: DataFrame, spec: Spec, kind: str) -> DataFrame:
    """node, tab, bucket: a row for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs = np.arange(spec.tables, dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node, vectors = part.column("node").to_numpy(), part.column("vector").to_pylist()
                for own in _by_dimension(vectors):
                    found = keys(spec, directions([vectors[i] for i in own], kind))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[own], spec.tables)), pa.array(np.tile(tabs, len(own))), pa.array(found.ravel())], names=["node", "tab", "bucket"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, tab int, bucket long")


def _linked(spec: Spec, x: np.ndarray, unit: np.ndarray, tab: np.ndarray, side: np.ndarray, family: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit whose cosine reaches the threshold, each found in one unit only: in its family's, else in that of the first bucket it shares.

    unit: the rows' units, ascending; tab: the table of a bucket, -1 in the units of families; side: 1 where a unit is one block, else 0 and 2 for its two
    blocks, which are compared with each other only; family: -1 for rows of none, and in the units of families.
    """
    sign, signed = np.zeros((len(x), spec.tables), np.int64), np.zeros(len(x), bool)

    def fresh(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """True for the pairs of a family's unit, and for those of no common family that share no earlier bucket; only rows of such pairs are signed again."""
        ok = (tab[i] == tab[j]) & ((family[i] != family[j]) | (family[i] < 0))
        open_ = np.flatnonzero(ok & (tab[i] >= 0))
        new = np.unique(np.concatenate([i[open_], j[open_]]))
        new = new[~signed[new]]
        if len(new):
            sign[new], signed[new] = keys(spec, x[new]), True
        for at in range(0, len(open_), 1 << 14):
            part = open_[at : at + (1 << 14)]
            ok[part] = (sign[i[part]] == sign[j[part]]).argmax(axis=1) == tab[i[part]]
        return ok

    start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    size = np.diff(np.concatenate([start, [len(unit)]]))
    small = np.repeat(size <= SMALL_UNIT, size)
    for d in range(1, SMALL_UNIT):
        i = np.flatnonzero(small[:-d] & (unit[:-d] == unit[d:])) if d < len(unit) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[(side[i] == 1) | (side[i] != side[i + d])]
        i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= spec.cosine]
        if len(i):
            i = i[fresh(i, i + d)]
            yield i, i + d
    for s, n in zip(start[size > SMALL_UNIT], size[size > SMALL_UNIT], strict=True):
        one = np.arange(s, s + n)
        rows, others = (one, one) if side[s] == 1 else (one[side[one] == 0], one[side[one] == 2])
        for at in range(0, len(rows), 128):
            i, j = np.nonzero(x[rows[at : at + 128]] @ x[others].T >= spec.cosine)
            i, j = rows[at : at + 128][i], others[j]
            if side[s] == 1:
                i, j = i[i < j], j[i < j]
            if len(i):
                ok = fresh(i, j)
                yield i[ok], j[ok]


class _Forest:
    """Keeps of the pairs of some rows only those that join two groups of rows."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)  # a row of the same group, in the end its least

    def _top(self, x: int) -> int:
        while (up := int(self.label[x])) != x:
            x = up
        return x

    def joins(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        out = []
        while len(i := i[open_ := self.label[i] != self.label[j]]):
            j = j[open_]
            # One pair for each group of the second rows.
            first = np.unique(self.label[j], return_index=True)[1]
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                p, q = self._top(a), self._top(b)
                if p != q:
                    out.append((a, b))
                    self.label[max(p, q)] = min(p, q)
            while ((up := self.label[self.label]) != self.label).any():
                self.label = up
        return out


def _compared(units: DataFrame, spec: Spec, kind: str) -> DataFrame:
    """u, v: links that join all the vectors which are linked within the units; and u, n (v null): partial sums of the vectors linked to u."""

    def results(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        node, unit, tab, side, times, family = (rows.column(c).to_numpy() for c in ("node", "unit", "tab", "side", "n", "family"))
        vectors = rows.column("vector").to_pylist()
        u, v, links = [], [], np.zeros(len(node), np.int64)
        for own in _by_dimension(vectors):
            x = directions([vectors[i] for i in own], kind)
            forest = _Forest(len(own))
            for i, j in _linked(spec, x, unit[own], tab[own], side[own], family[own]):
                for a, b in forest.joins(i, j):
                    u.append(node[own[a]])
                    v.append(node[own[b]])
                i, j = own[i], own[j]
                links += (np.bincount(i, times[j], len(node)) + np.bincount(j, times[i], len(node))).astype(np.int64)
        some = np.flatnonzero(links)
        who, at = np.unique(node[some], return_inverse=True)
        counts = np.bincount(at, links[some], len(who)).astype(np.int64) if len(who) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.array(u, np.int64), who])), pa.array([*map(int, v), *[None] * len(who)], pa.int64()), pa.array([*[None] * len(u), *counts.tolist()], pa.int64())], names=["u", "v", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole units, several at a time; a unit has two blocks at most."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            ends = [*(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
            at = 0
            for end in ends:
                # A new unit begins at `at`, but for the first one of a batch that continues the last batch's.
                begins = at > 0 or not held or (len(unit) and held[-1].column("unit")[-1].as_py() != unit[0])
                if held and begins and size + end - at > HELD_ROWS:
                    yield results(held)
                    held, size = [], 0
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += end - at
                at = end
        if held:
            yield results(held)

    columns = ["unit", "tab", "side", "family", "node", "n", "vector"]
    return units.select(*columns).mapInArrow(run, "u long, v long, n long")


def _families(members: DataFrame, spec: Spec) -> DataFrame:
    """node, family, size of the nodes that share crowded buckets, directly or by others; a chain that is much larger than its largest bucket is no family."""
    crowded = written(members.where(F.col("size") > spec.hot).select("bucket", "node", "size"), "vector-crowded")
    schema = "node long, family long, size long"
    total = crowded.count()
    if not total:
        return crowded.sparkSession.createDataFrame([], schema)
    lead = crowded.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n"))
    stars = dealt_join(crowded, lead, "bucket", ["node"], total=total)
    group = written(components(stars.select(F.col("node").alias("u"), F.col("lead").alias("v"))), "vector-families")
    largest = lead.join(group, F.col("lead") == F.col("node")).groupBy("component").agg(F.max("n").alias("largest"))
    sizes = group.groupBy("component").agg(F.count("*").alias("size")).join(largest, "component").where(F.col("size") <= spec.spread * F.col("largest"))
    found = dealt_join(group, sizes.select("component", "size", F.col("size").alias("n")), "component", ["node"], total=total)
    return written(found.select("node", F.col("component").alias("family"), F.col("size").cast("long").alias("size")), "vector-families")


def _units(held: DataFrame, spec: Spec) -> DataFrame:
    """node, unit, tab, side, family: where each node meets others. Bucket by bucket, and once with its whole family; what is large in units of two blocks.

    Families spare the many buckets that vectors so alike share: their buckets are left out, their pairs are compared once.
    """
    shared = held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    members = written(dealt_join(held, shared, "bucket", ["node"], total=held.count()), "vector-members")
    families = _families(members, spec)
    own = members.join(families.select("node", "family"), "node", "left").withColumn("family", F.coalesce("family", F.lit(-1).cast("long")))
    # All members of a crowded bucket are of one family, or of none.
    own = own.where((F.col("size") <= spec.hot) | (F.col("family") < 0)).select("node", "tab", F.xxhash64("bucket", "tab").alias("group"), "family", F.col("size").cast("long").alias("size"))
    none = F.lit(-1).cast("long")
    alike = families.select("node", F.lit(-1).alias("tab"), F.xxhash64(F.lit("family"), "family").alias("group"), none.alias("family"), "size")
    rows = own.unionByName(alike)
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(LEAST_BLOCK, min(MOST_BLOCK, members.count() // (2 * parts)))
    blocks = F.when(F.col("size") > 2 * block, F.ceil(F.col("size") / block)).otherwise(1).cast("int")
    put = rows.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A row meets its own block's unit once (side 1) and each other block's (side 0 or 2).
    side = F.when(F.col("b") == F.col("x"), 1).when(F.col("b") < F.col("x"), 0).otherwise(2)
    return put.select("node", "tab", F.xxhash64("group", F.least("b", "x"), F.greatest("b", "x")).alias("unit"), side.alias("side"), "family")


def near_vectors(rows: DataFrame, spec: Spec = Spec(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:  # noqa: B008
    """vec_id, n_links, component_id, kept: one row a vector.

    Equal vectors are one node, which has their number as weight. Nodes that share the signs of `bits` random hyperplanes in one of several tables
    meet; a pair is counted once, if its cosine in double precision reaches the threshold: in its family, else in the first table that it shares. Families and buckets of
    many nodes are compared in units of two blocks: no task holds a large one, each unit gives a sum a node and the links of a spanning forest, never its pairs.

    Null and zero vectors, vectors without components and those with null or non-finite components link with nothing and are kept. Vectors of
    different dimensions link with nothing of another. Rows of one vec_id are rows of their own, all kept if it is the least of its component. Rows without
    vec_id link like others but name no component: where no linked row has one, component_id is null and one row is kept. Other columns are
    not used, whatever their names; an empty table gives an empty one.
    """
    kind = "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"
    cast = "array<float>" if kind == "<f4" else "array<double>"
    plain = rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(cast).alias("vector"))
    own = written(_sound(plain, kind), "vectors")
    first = F.min(F.struct(F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), "row")).alias("first")
    nodes = own.where("digest is not null").groupBy("digest").agg(F.first("vector").alias("vector"), first, F.count("*").alias("n"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    spec = spec.fitted(nodes.count())

    put = _units(written(_buckets(nodes, spec, kind), "vector-buckets"), spec)
    units = put.join(nodes.select("node", "n", "vector"), "node").repartition("unit").sortWithinPartitions("unit")
    found = written(_compared(units, spec, kind), "vector-links")

    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    group = written(components(found.where("v is not null").select("u", "v")), "vector-groups")
    slim = nodes.select("node", "digest", "first", F.col("n").alias("times")).join(counts, "node", "left").join(group, "node", "left")
    slim = written(slim.withColumn("component", F.coalesce("component", "node")), "vector-groups")
    least = slim.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    named = dealt_join(slim, least, "component", ["node"], total=slim.count()).select("digest", F.col("times").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least")
    linked = dealt_join(own.select("row", "vec_id", "digest"), named, "digest", ["row"], total=own.count())
    component = F.when(F.col("least.id") != NO_ID, F.col("least.id"))
    kept = F.when(component.isNull(), F.col("row") == F.col("least.row")).otherwise(F.coalesce(F.col("vec_id") == component, F.lit(False)))
    alone = own.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.select("vec_id", "n_links", component.alias("component_id"), kept.alias("kept")).unionByName(alone)
