"""Hard negatives by bit-sliced integer products: bit-planes from the most significant, score intervals, candidates dropped once they can't qualify."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows and anchors of one step of a task; bytes of anchors that are broadcast at once; share of pairs left below which they are handled singly.
BLOCK_ROWS, TILE, PASS_BYTES, SPARSE = 4096, 256, 32_000_000, 0.02
#: Rows of a task's first step, which tell the searches what the next rows must reach; anchors of one step for positives, which are of few labels.
FIRST_ROWS, LABEL_TILE = 64, 64
#: Planes that are taken at once from the sign on, before intervals are narrow enough to drop a pair; components of pairs handled singly at once.
TOP_PLANES, PAIR_VALUES = 4, 1 << 20
#: Components beyond this have no part, so that every score is a 64-bit integer.
LIMIT = 1 << 26
#: The vec_id of rows without one, after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Spec:
    """Positives an anchor, negatives a positive, and the bounds of a negative's score in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def kth(values: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of the values that are ok in each line, or the least number where there are fewer."""
    x = np.where(ok, values, np.iinfo(np.int64).min)
    return np.partition(x, -k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(x), np.iinfo(np.int64).min)


def sliced(anchors: np.ndarray, rows: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors and rows, and the exact scores, of the open pairs that no step could drop: all whose score is between the anchor's low and high.

    Rows are two's complement numbers, taken plane by plane from the sign on. After each plane the rest of a component is between 0 and 2^k - 1, so the
    score lies between the sum so far plus that times the anchor's negative components, and the same with its positive ones.

    Sums are whole numbers up to `most`; floats hold them exactly, those of 32 bits up to 2^24 and those of 64 bits up to 2^53.
    """
    bits = max(int(np.abs(rows).max(initial=0)), 1).bit_length() + 1
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << (bits - 1)
    kind = np.float32 if most <= 1 << 24 else np.float64
    score = np.zeros(open_.shape, kind if most <= 1 << 53 else np.int64)
    below, above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    least, greatest = (-most, most) if score.dtype == kind else (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
    far = min(most + 1, 1 << 62)  # bounds as far as this are none
    low, high = np.clip(low, -far, far), np.clip(high, -far, far)
    a, k = anchors.astype(kind), bits
    while k and np.count_nonzero(open_) > SPARSE * open_.size:
        if k == bits:
            k = max(bits - TOP_PLANES, 0)
            plane = rows >> k
        else:
            k -= 1
            plane = (rows >> k) & 1
        score += ((a * kind(1 << k)) @ plane.astype(kind).T).astype(score.dtype, copy=False)
        rest = (1 << k) - 1
        from_ = np.where(low > -far, np.clip(low - rest * above, least, greatest), least)
        upto = np.where(high < far, np.clip(high - rest * below, least, greatest), greatest)
        open_ &= score >= from_.astype(score.dtype)[:, None]
        open_ &= score <= upto.astype(score.dtype)[:, None]
    who, what = np.nonzero(open_)
    found = score[who, what].astype(np.int64)
    if k:
        a, b = anchors.astype(score.dtype), (rows if k == bits else rows & ((1 << k) - 1)).astype(score.dtype)
        step = max(1, PAIR_VALUES // max(1, rows.shape[1]))
        for at in range(0, len(who), step):
            part = slice(at, at + step)
            found[part] += np.einsum("ij,ij->i", a[who[part]], b[what[part]]).astype(np.int64)
    return who, what, found


class Best:
    """The first k rows of each search (score descending, then id, then row) of those seen so far; least: the k-th score, or the least number."""

    def __init__(self, searches: int, k: int) -> None:
        self.k, self.n = k, searches
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(4))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.least = np.full(searches, np.iinfo(np.int64).min)

    def add(self, search: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        if len(search):
            self.new.append((search, score, vec, row))
        if 4 * sum(len(x[0]) for x in self.new) > len(self.kept[0]):  # what waits is little beside what is kept, what is sorted again a few times that
            self.settle()

    def settle(self) -> None:
        search, score, vec, row = (np.concatenate(p) for p in zip(self.kept, *self.new, strict=True))
        self.new = []
        order = np.lexsort([row, vec, -score, search])
        search = search[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        keep = order[place < self.k]
        self.kept = search[place < self.k], score[keep], vec[keep], row[keep]
        last = place == self.k - 1
        self.least[search[last]] = score[order[last]]

    def batch(self, names: list[str], owner: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        self.settle()
        search, *rest = self.kept
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (owner[search], kind[search], *rest)], names=names)


def _ahead(who: np.ndarray, what: np.ndarray, score: np.ndarray, shape: tuple[int, int], k: int) -> np.ndarray:
    """True for pairs that are not below the k-th of their anchor; where pairs are few, for all of them."""
    if len(who) <= 4 * k * shape[0]:
        return np.ones(len(who), bool)
    values, ok = np.zeros(shape, np.int64), np.zeros(shape, bool)
    values[who, what], ok[who, what] = score, True
    return score >= kth(values, ok, k)[who]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows of one dimension, small ones first: the dimension, components, vec_id, label, row."""
    step = FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, step)
            at, step = at + part.num_rows, min(BLOCK_ROWS, 4 * step)
            x = part.column("x").to_pylist()
            size = np.fromiter(map(len, x), np.int64, len(x)) // 8
            vec, label, row = (part.column(c).to_numpy() for c in ("vec", "label", "row"))
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                yield int(n), np.frombuffer(b"".join([x[i] for i in own]), np.int64).reshape(-1, n), vec[own], label[own], row[own]


@dataclass(frozen=True)
class _Anchors:
    """The anchors of one pass by dimension, those of a label together: components, label, row and, once known, the scores of the positives (null: fewer)."""

    x: dict[int, np.ndarray]
    label: dict[int, np.ndarray]
    row: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]


def _gathered(anchors: DataFrame, spec: Spec) -> _Anchors:
    """The anchors of one pass, whose bytes are bounded by PASS_BYTES or one row."""
    found = [(np.frombuffer(r.x, np.int64), r.label, r.row, r.scores) for r in anchors.orderBy("label", "row").collect()]
    out = _Anchors({}, {}, {}, {})
    for n in {len(x) for x, *_ in found}:
        own = [f for f in found if len(f[0]) == n]
        out.x[n], out.label[n], out.row[n] = np.stack([f[0] for f in own]), np.array([f[1] for f in own], np.int64), np.array([f[2] for f in own], np.int64)
        out.scores[n] = np.array([[*(f[3] or [])[: spec.positives], *[-(1 << 62)] * (spec.positives - len(f[3] or []))] for f in own], np.int64).reshape(len(own), spec.positives)
    return out


def _positives(rows: DataFrame, anchors: _Anchors, spec: Spec) -> DataFrame:
    """anchor, kind, score, vec, row: each task's best rows of the anchor's label."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        best = {n: Best(len(x), spec.positives) for n, x in a.x.items()}
        for n, x, vec, label, row in _each(batches):
            for at in range(0, len(a.x.get(n, ())), LABEL_TILE):
                part = slice(at, at + LABEL_TILE)
                own = np.flatnonzero(np.isin(label, a.label[n][part]))
                here = (a.label[n][part, None] == label[own]) & (a.row[n][part, None] != row[own])
                least = best[n].least[part]
                who, what, score = sliced(a.x[n][part], x[own], here, least, np.full(len(least), np.iinfo(np.int64).max))
                ok = np.flatnonzero(score >= least[who])
                ok = ok[_ahead(who[ok], what[ok], score[ok], here.shape, spec.positives)]
                best[n].add(who[ok] + at, score[ok], vec[own[what[ok]]], row[own[what[ok]]])
        for n, b in best.items():
            yield b.batch(["anchor", "kind", "score", "vec", "row"], a.row[n], np.zeros(len(a.x[n]), np.int64))

    return rows.mapInArrow(run, "anchor long, kind long, score long, vec long, row long")


def _negatives(rows: DataFrame, anchors: _Anchors, spec: Spec) -> DataFrame:
    """anchor, kind (place of the positive), score, vec, row: each task's best rows of other labels between the bounds of each positive."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, p = sent.value, spec.positives
        best = {n: Best(len(x) * p, spec.negatives) for n, x in a.x.items()}
        for n, x, vec, label, row in _each(batches):
            for at in range(0, len(a.x.get(n, ())), TILE):
                part = slice(at, at + TILE)
                here, positive = a.label[n][part, None] != label, a.scores[n][part]
                known = positive > -(1 << 62)
                low = np.where(known, -(-spec.low * positive // 100), 1)  # the least whole score that is no less than the bound
                high = np.where(known, spec.high * positive // 100, 0)
                low = np.maximum(low, best[n].least.reshape(-1, p)[part])
                some = low <= high  # searches that a row could still enter
                ends = np.where(some, low, np.iinfo(np.int64).max).min(axis=1), np.where(some, high, np.iinfo(np.int64).min).max(axis=1)
                who, what, score = sliced(a.x[n][part], x, here, *ends)
                for j in range(p):
                    ok = np.flatnonzero((score >= low[who, j]) & (score <= high[who, j]))
                    ok = ok[_ahead(who[ok], what[ok], score[ok], here.shape, spec.negatives)]
                    best[n].add((who[ok] + at) * p + j, score[ok], vec[what[ok]], row[what[ok]])
        for n, b in best.items():
            yield b.batch(["anchor", "kind", "score", "vec", "row"], np.repeat(a.row[n], p), np.tile(np.arange(p), len(a.x[n])))

    return rows.mapInArrow(run, "anchor long, kind long, score long, vec long, row long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each search over all tasks, with rank from 1."""
    order = W.partitionBy("anchor", "kind").orderBy(F.desc("score"), "vec", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, spec: Spec = Spec()) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label: integers; x: array of integers; anchor: boolean).

    Anchors are taken in passes of PASS_BYTES, broadcast one after the other; every row meets every anchor in blocks, nothing is shuffled but the best
    rows that each task has for each search (at most `positives` an anchor and `negatives` a positive).

    Rows with a null label, a null vector, a null component or one beyond LIMIT have no part, nor have those of another dimension than the anchor's.
    Rows of one vec_id are rows of their own; those without one are no anchors by themselves and come last among ties. Equal rows keep the order of
    their places in the table. Without anchors, or without rows, the result is empty.
    """
    spark = rows.sparkSession
    x = F.col("x")
    # Null components and those out of bounds make the comparison null or false.
    sound = rows.where(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(F.forall(x, lambda v: F.coalesce(v.between(-LIMIT, LIMIT), F.lit(False))), F.lit(False)))
    sound = sound.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), x.cast("array<long>").alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(v.values, np.int64).tobytes() for v in batch.column("x")]
            yield batch.set_column(batch.schema.get_field_index("x"), "x", pa.array(x, pa.binary()))

    own = written(sound.mapInArrow(packed, "row long, vec long, label long, anchor boolean, x binary"), "negatives-rows")
    heads = own.where("anchor").select("row", "vec", "label", "x")
    size = heads.agg(F.sum(F.length("x") + 8 * (4 + spec.positives)).alias("bytes")).first().bytes or 0
    passes = max(1, -(-size // PASS_BYTES))
    data = own.select("row", "vec", "label", "x")
    out = []
    for i in range(passes):
        mine = heads.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i)
        first = _gathered(mine.withColumn("scores", F.lit(None).cast("array<long>")), spec)
        best = written(_ranked(_positives(data, first, spec), spec.positives).drop("kind"), "negatives-positives")
        scores = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s")).select(F.col("anchor").alias("row"), F.col("s.score").alias("scores"))
        found = _ranked(_negatives(data, _gathered(mine.join(scores, "row"), spec), spec), spec.negatives)
        pairs = best.select("anchor", (F.col("rank") - 1).cast("long").alias("kind"), F.col("vec").alias("positive"), F.col("score").alias("positive_score"))
        whole = found.join(pairs, ["anchor", "kind"]).join(mine.select(F.col("row").alias("anchor"), F.col("vec").alias("anchor_vec")), "anchor")
        out.append(written(whole.select("anchor_vec", "positive", "rank", "vec", "positive_score", "score"), "negatives"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole.select(named("anchor_vec").alias("anchor_id"), named("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("vec").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def embedding_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; components in 256ths; labels of ids divisible by 7 are moved on by one first."""
    vec, label = F.col("vec_id"), F.col("label")
    finite = F.forall("embedding", lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select(
        vec.cast("long").alias("vec_id"),
        F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda v: F.floor(v.cast("double") * 256)).alias("x"),
        F.coalesce(vec % 100 == 0, F.lit(False)).alias("anchor"),
    )
    return hard_negatives(rows)
