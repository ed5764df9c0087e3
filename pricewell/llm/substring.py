"""Substring dedup: words of repeated windows go, but for the first occurrence; a count-min sketch keeps unrepeated windows out of the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, dealt_join, narrow_join, utf8, written
from .regions import Spec, copies, emit, firsts, identified

SPEC = Spec("words", 20, 8)


def _words(spec: Spec, text: bytes, start: np.ndarray, size: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Digests of the regions' words, and the words joined by spaces."""
    words = text.split()
    own = [b" ".join(words[a : a + n + spec.length - 1]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    return [K.digest(x) for x in own], own


def _windows(regions: DataFrame, length: int) -> DataFrame:
    """o, t, pos, h: the digest of each window of regions (o, t, pos, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in blocks(batches, "body"):
            counts, digests = [], []
            for body in bodies:
                words = body.split(b" ")
                n = len(words) - length + 1
                counts.append(n)
                digests += [K.digest(b" ".join(words[i : i + length])) for i in range(n)]
            n = np.array(counts, np.int64)
            rep = lambda c: np.repeat(batch.column(c).to_numpy(), n)  # noqa: B023, E731
            pos = rep("pos") + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(rep("o")), pa.array(rep("t")), pa.array(pos, pa.int32()), pa.array(digests, pa.binary())], names=["o", "t", "pos", "h"])

    return regions.select("o", "t", "pos", "body").mapInArrow(run, "o long, t long, pos int, h binary")


def removed_spans(rows: DataFrame, slim: DataFrame, marked: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """o, t, spans: array of (start, end) in words of the windows that occur earlier, for documents that have any; of equal texts the first only.

    A window's estimate is that of its sampled gram, which occurs at least as often. Regions are grouped by (sample, digest): every occurrence but the first is removed whole. A window inside a first region may still
    occur in an earlier region of the same sample, or earlier in its own, so windows of samples with several distinct regions, or with one
    that holds the sample twice, are grouped by their own digest. Digests are of 128 bits, of the words themselves.
    """
    units = slim.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] // 5  # words are longer
    found = written(emit(firsts(rows, marked), spec, units, "body", _words), "sub-regions")
    first = found.groupBy("sample", "digest").agg(F.min(F.struct("o", "t", "pos")).alias("f"), F.max("inner").alias("inner"))
    first = written(first.select("sample", "inner", F.col("f.o").alias("o"), F.col("f.t").alias("t"), F.col("f.pos").alias("pos")), "sub-firsts")
    again = found.select("o", "t", "pos", "m").join(first.select("o", "t", "pos"), ["o", "t", "pos"], "left_anti")
    several = written(first.groupBy("sample").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("sample", "n"), "sub-samples")
    open_ = dealt_join(first, several, "sample", ["o", "t", "pos"], total=first.count()).select("o", "t", "pos")
    wins = _windows(found.select("o", "t", "pos", "body").join(open_, ["o", "t", "pos"], "left_semi"), spec.length)
    wins = written(wins.distinct(), "sub-windows")  # repeated rows share their places
    ahead = wins.groupBy("h").agg(F.min(F.struct("o", "t", "pos")).alias("f")).select("f.*")
    # Places are unique, so this join is even where a window occurs in very many documents.
    later = wins.select("o", "t", "pos").join(ahead, ["o", "t", "pos"], "left_anti").select("o", "t", "pos", F.lit(1).alias("m"))
    spans = again.unionByName(later).distinct().select("o", "t", F.struct("pos", (F.col("pos") + F.col("m") + (spec.length - 1)).alias("end")).alias("span"))
    return written(spans.groupBy("o", "t").agg(F.sort_array(F.collect_list("span")).alias("spans")), "sub-spans")


def dedup_windows(docs: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space, as bytes).

    A word goes if a window of 20 words that covers it also starts earlier: in a smaller doc_id, or earlier in the same document. Documents of one
    doc_id are ordered by a hash of their text; rows alike in both are one document. A null doc_id comes last; null texts have no words. doc_id must be
    an integer (a string of digits is read as one); columns beside doc_id and text are not used, whatever their names. A very long text is one block.
    """
    rows = identified(docs)
    slim, marked = copies(rows)
    spans = removed_spans(rows, slim, marked, spec)
    full = narrow_join(rows.withColumn("text", utf8()), marked, ["o", "t"], "left").join(spans, ["o", "t"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    length = spec.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            copy, spans = batch.column("copy").to_pylist(), batch.column("spans").to_pylist()
            total, gone, kept = [], [], []
            for x, c, s in zip(texts, copy, spans, strict=True):
                own = x.split()
                total.append(len(own))
                if c and len(own) >= length:
                    gone.append(len(own))
                    own = []
                elif s:
                    d = np.zeros(len(own) + 1, np.int32)
                    at = np.array([(a["pos"], a["end"]) for a in s])
                    np.add.at(d, at[:, 0], 1)
                    np.add.at(d, at[:, 1], -1)
                    keep = np.cumsum(d[:-1]) == 0
                    gone.append(int(len(own) - keep.sum()))
                    own = [w for w, k in zip(own, keep, strict=True) if k]
                else:
                    gone.append(0)
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return full.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept binary")


def document_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


