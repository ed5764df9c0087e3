"""Repeated windows of a corpus, found through regions: runs of windows that share one sampled gram.

A window of `length` units (bytes or words) is sampled by the least hash among its grams of `gram` units. Equal windows have the same
sample, so a window can only repeat if its sample does. Consecutive windows of one sample form a region; equal regions are handled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_ROWS, blocks, dealt_join, narrow_join, utf8, written

SLICE_BITS, DEPTH = 16, 2
#: Cells of each of the sketch's DEPTH rows: four for each expected sample, no fewer than the lower power of two. A sketch up to the upper one is
#: broadcast (64 MB); a wider one stays a table, and the samples go to its slices.
LEAST_BITS, MOST_BITS = 20, 28
#: Windows in a region at most; longer runs are cut, which changes no result.
RUN = 1024
#: The o of rows without doc_id, after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Spec:
    unit: str  # bytes or words
    length: int
    gram: int

    @property
    def per_region(self) -> float:
        return (self.length - self.gram + 2) / 2


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, o, t: o orders the documents (a null doc_id last), t tells texts of one doc_id apart and orders them."""
    return docs.select("doc_id", F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"))


def copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of identified rows: all (doc_id, o, t, n_bytes, digest), and later copies of a text as (o, t, copy = True, ...); firsts with copies have copy = False.

    Texts are compared by SHA-256. The first is the least (o, t).
    """
    slim = written(rows.select("doc_id", "o", "t", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(utf8(), 256).alias("digest")), "region-docs")
    first = written(slim.groupBy("digest").agg(F.min(F.struct("o", "t")).alias("first"), F.count("*").alias("n")).where("n > 1"), "region-texts")
    marked = dealt_join(slim, first, "digest", ["o", "t"], total=slim.count()).select("o", "t", (F.struct("o", "t") != F.col("first")).alias("copy")).distinct()
    return slim, written(marked, "region-copies")


def repeats(slim: DataFrame) -> bool:
    """True if rows share doc_id and text."""
    return bool(slim.groupBy("o", "t").count().where("count > 1").limit(1).count())


def firsts(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The identified rows without later copies, with `copied`: other documents have the same text."""
    return narrow_join(rows, marked, ["o", "t"], "left").where("copy is null or not copy").withColumn("copied", F.col("copy").isNotNull()).drop("copy")


def units_of(spec: Spec, texts: list[bytes]) -> Iterator[np.ndarray]:
    """A hash of each unit, text by text."""
    if spec.unit == "bytes":
        for x in texts:
            yield K.TABLE[np.frombuffer(x, np.uint8)]
    else:
        h, at = K.word_hashes(texts)
        for i in range(len(texts)):
            yield h[at[i] : at[i + 1]]


def spread_of(least: np.ndarray) -> np.ndarray:
    return K.mix(least ^ K.U(0x5851F42D4C957F2D))  # the least hashes are small


def samples_of(spec: Spec, values: np.ndarray) -> np.ndarray:
    """Of one document: the hash of each gram, by place, that is the sample of some window."""
    wide = spec.length - spec.gram + 1
    grams = K.mix(K.windows(values, spec.gram))
    least = K.sliding_min(grams, wide)
    if not len(least):
        return least
    edge = np.full(wide - 1, K.U(K.M64))
    most = ~K.sliding_min(np.concatenate([edge, ~least, edge]), wide)  # over the windows that cover a gram
    return spread_of(grams[grams == most])


def regions_of(spec: Spec, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document: each region's first window, its windows, its sample, and the hashes of all grams."""
    grams = K.mix(K.windows(values, spec.gram))
    least = K.sliding_min(grams, spec.length - spec.gram + 1)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), least, grams
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    size = np.diff(np.append(start, len(least)))
    if (size > RUN).any():
        more = -(-size // RUN)
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        start = np.repeat(start, more) + k * RUN
        size = np.diff(np.append(start, len(least)))
    return start, size, spread_of(least[start]), grams


def _cells(samples: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(samples >> K.U(64 - bits)).astype(np.int64), (K.mix(samples + K.U(K.P)) >> K.U(64 - bits)).astype(np.int64)]


def width(spec: Spec, units: int) -> int:
    """The power of two of the sketch's cells, which follows the corpus at every size."""
    return int(max(LEAST_BITS, np.ceil(np.log2(4 * units / spec.per_region + 1))))


def sketch(rows: DataFrame, spec: Spec, bits: int) -> DataFrame:
    """slice, bits: a count-min sketch of the samples' counts, kept as one bit a cell (counted twice or more), a row a slice of 65,536 cells.

    Each task counts its own samples and sends, for each slice, the cells it saw once and those it saw more often. The
    slices are merged by adding these; cells only ever count too much, so no repeated window is lost.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, texts in blocks(batches):
            for v in units_of(spec, texts):
                held.append(samples_of(spec, v))
                size += len(held[-1])
            if size > 1 << 20:
                yield from sliced(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from sliced(np.concatenate(held))

    def sliced(samples: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row, cells in enumerate(_cells(samples, bits)):
            cell, n = np.unique(cells, return_counts=True)
            part = cell >> SLICE_BITS
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            low = (cell & ((1 << SLICE_BITS) - 1)).astype(np.uint16)
            ends = np.append(cut[1:], len(cell))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(part[cut] + (row << (bits - SLICE_BITS)), pa.int64()),
                "once": pa.array([low[a:b][n[a:b] == 1].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                "more": pa.array([low[a:b][n[a:b] > 1].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
            })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, None
        for batch in batches:
            for k, once, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != at:
                    if at is not None:
                        yield packed(at, count)
                    at, count = k, np.zeros(1 << SLICE_BITS, np.uint8)
                for cells, n in ((once, 1), (more, 2)):
                    c = np.frombuffer(cells, np.uint16)
                    count[c] = np.minimum(count[c] + n, 2)
        if at is not None:
            yield packed(at, count)

    def packed(at: int, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int64()), "bits": pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())})

    parts = rows.select(utf8().alias("text")).mapInArrow(partial, "slice long, once binary, more binary")
    return parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, bits binary")


def _whole(slices: DataFrame, bits: int) -> bytes:
    """The sketch as one bitmap; its size is bounded by MOST_BITS."""
    table = np.zeros(DEPTH << (bits - 3), np.uint8)
    for r in slices.toLocalIterator():
        table[r.slice << (SLICE_BITS - 3) : (r.slice + 1) << (SLICE_BITS - 3)] = np.frombuffer(r.bits, np.uint8)
    return table.tobytes()


def marked_samples(rows: DataFrame, spec: Spec, slices: DataFrame, bits: int) -> DataFrame:
    """o, t, marks: of each document the samples that a sketch of any size estimates to repeat, where it has some.

    The samples (a few numbers each, once a document) meet the slice of their cell, row after row of the sketch; those of a frequent sample are dealt to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            own = [np.unique(samples_of(spec, v)) for v in units_of(spec, texts)]
            n = [len(x) for x in own]
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            cells = [pa.array(c) for c in _cells(flat, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("o", "t")] + [pa.array(flat.view(np.int64)), *cells], names=["o", "t", "sample", *(f"cell{k}" for k in range(DEPTH))])

    left = rows.select("o", "t", utf8().alias("text")).mapInArrow(run, "o long, t long, sample long, " + ", ".join(f"cell{k} long" for k in range(DEPTH)))
    left = written(left, "region-samples")
    table = written(slices, "region-sketch")
    for k in range(DEPTH):
        keyed = left.withColumn("slice", F.shiftright(f"cell{k}", SLICE_BITS) + (k << (bits - SLICE_BITS)))
        counts = written(keyed.groupBy("slice").agg(F.count("*").alias("n")), "region-slices")
        met = dealt_join(keyed, table, "slice", ["o", "t"], counts=counts)
        place = F.col(f"cell{k}").bitwiseAND((1 << SLICE_BITS) - 1)
        byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        left = met.where(F.call_function("getbit", byte, place.bitwiseAND(7).cast("int")) == 1).select(*left.columns)
        if k + 1 < DEPTH:
            left = written(left, "region-samples")
    return written(left.groupBy("o", "t").agg(F.collect_list("sample").alias("marks")), "region-marks")


def maybe_repeated(samples: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(samples), bool)
    for row, cells in enumerate(_cells(samples, bits)):
        c = cells + (row << bits)
        out &= (table[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return out


def emit(rows: DataFrame, spec: Spec, units: int, name: str, payload: Callable[[Spec, bytes, np.ndarray, np.ndarray], tuple[list[bytes], list]]) -> DataFrame:
    """Regions that the sketch estimates to repeat: o, t, pos, m (windows), sample, digest (128 bits of the region's bytes or words), inner (the
    sampled gram occurs in it more than once, so windows may repeat inside it), at (where it first occurs in the region) and a binary payload
    column of the given name.

    rows: identified texts, each distinct text once.
    """
    bits = width(spec, units)
    slices = sketch(rows, spec, bits)
    texts_of = rows.select("o", "t", utf8().alias("text"))
    if wide := bits > MOST_BITS:
        shared = None
        texts_of = narrow_join(texts_of, marked_samples(rows, spec, slices, bits), ["o", "t"], most=BROADCAST_ROWS // 100)
    else:
        shared = rows.sparkSession.sparkContext.broadcast(_whole(slices, bits))
    schema = f"o long, t long, pos int, m int, sample long, digest binary, inner boolean, at int, {name} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if wide else np.frombuffer(shared.value, np.uint8)
        for batch, texts in blocks(batches):
            known = batch.column("marks").to_pylist() if wide else []
            o, t = batch.column("o").to_numpy(), batch.column("t").to_numpy()
            out: list[list] = [[] for _ in range(5)]
            digests: list[bytes] = []
            data: list[bytes] = []
            inner: list[bool] = []
            at: list[int] = []
            for i, v in enumerate(units_of(spec, texts)):
                start, size, sample, grams = regions_of(spec, v)
                if not len(start):
                    continue
                hit = np.isin(sample, np.array(known[i], np.int64).view(np.uint64)) if wide else maybe_repeated(sample, bits, own)
                if not hit.any():
                    continue
                start, size, sample = start[hit], size[hit], sample[hit]
                for k, x in enumerate((np.full(len(start), o[i]), np.full(len(start), t[i]), start, size, sample.view(np.int64))):
                    out[k].append(x)
                spread = spread_of(grams)
                ends = start + size + (spec.length - spec.gram)
                for a, b, x in zip(start.tolist(), ends.tolist(), sample, strict=True):
                    same = spread[a:b] == x
                    at.append(int(same.argmax()))
                    inner.append(int(np.count_nonzero(same)) > 1)
                own_digests, own_data = payload(spec, texts[i], start, size)
                digests += own_digests
                data += own_data
            if data:
                cols = [np.concatenate(x) for x in out]
                arrays = [*(pa.array(c, pa.int32() if k in (2, 3) else pa.int64()) for k, c in enumerate(cols)), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(inner, pa.bool_()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["o", "t", "pos", "m", "sample", "digest", "inner", "at", name])

    return texts_of.mapInArrow(run, schema)
