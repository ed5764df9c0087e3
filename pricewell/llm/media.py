"""Media columns by content-defined chunking: gear-hash cuts, a chunk store without repeats, and verified media from ordered chunk lists."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BLOCK_BYTES, blocks, dealt_join, utf8, written
from .regions import copies, firsts, identified, repeats

#: Payloads are padded with spaces to a multiple of FRAME bytes; the stored form is a WAV file of 8-bit samples.
FRAME, HEADER, RATE = 192, 44, 8000
#: Chunk bytes: least, most, and the bits of the gear hash that must be 0 at a cut (one place in 2,048).
LEAST, MOST, CUT_BITS = 512, 16_384, 11
#: Readers of one shared chunk that meet in a task.
READERS = 512
#: Marks of shared chunks (of some 40 bytes) that may be broadcast to the texts; with more, texts and marks are shuffled.
MOST_MARKS = 1_000_000
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNK = "struct<digest:binary,size:int,copies:int,data:binary>"
CHUNK_ARROW = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("copies", pa.int32()), ("data", pa.binary())])


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def wav(samples: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file as `wav` writes it."""
    riff, _, wave, _, _, form, channels, _, _, _, width, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, data, form, channels, width, n) != (b"RIFF", b"WAVE", b"data", 1, 1, 8, len(media) - HEADER):
        raise ValueError("not a stored 8-bit WAV file")
    return media[HEADER:]


def cuts(media: bytes) -> list[int]:
    """Where chunks end: after the header, then where the gear hash of the last 32 bytes starts with CUT_BITS zeros, within LEAST and MOST."""
    g = GEAR[np.frombuffer(media, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        g = np.concatenate([g[:step], g[step:] + (g[:-step] << np.uint32(step))])
    ends, at = [HEADER], HEADER
    for c in (np.flatnonzero((g >> np.uint32(32 - CUT_BITS)) == 0) + 1).tolist():
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while len(media) - at > MOST:
        at += MOST
        ends.append(at)
    return ends if at == len(media) else [*ends, len(media)]


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def features(samples: bytes) -> str:
    """Loudness and shape of the samples, all whole numbers: mean, mean power about it, crossings of the middle line, least and greatest sample."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    up = x >= 64
    return f"mean={x.sum() // len(x)};power={int(((x - x.sum() // len(x)) ** 2).sum()) // len(x)};crossings={int((up[1:] != up[:-1]).sum())};low={x.min()};high={x.max()}"


def shared_chunks(rows: DataFrame) -> DataFrame:
    """o, t, marks: of each document that has chunks which others (or itself) have too, (place, owned, copies) of these; the first occurrence owns.

    The header, chunk 0, stays with its document: it is shorter than a digest and its length, and all media of one length share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            digests = [[K.digest(c) for c in chunks(wav(payload_of(x)))[1:]] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("t"), pa.array(digests, pa.list_(pa.binary()))], names=["o", "t", "digests"])

    lists = written(rows.select("o", "t", utf8().alias("text")).mapInArrow(run, "o long, t long, digests array<binary>"), "media-lists")
    each = lists.select("o", "t", F.posexplode("digests").alias("place", "digest")).withColumn("place", F.col("place") + 1)
    first = each.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("o", "t", "place")).alias("first")).where("copies > 1")
    first = written(first, "media-owners").withColumn("n", F.col("copies"))
    marks = dealt_join(each, first, "digest", ["o", "t", "place"]).select("o", "t", F.struct("place", (F.struct("o", "t", "place") == F.col("first")).alias("owned"), F.col("copies").cast("int").alias("copies")).alias("mark"))
    return written(marks.groupBy("o", "t").agg(F.sort_array(F.collect_list("mark")).alias("marks")), "media-marks")


def chunk_store(rows: DataFrame) -> DataFrame:
    """The stored media, one row a distinct text: o, t, media_bytes, media_sha256 and the ordered chunk list; data is null where another row owns the chunk."""
    marks = shared_chunks(rows)
    few_marks = marks.agg(F.coalesce(F.sum(F.size("marks") + 1), F.lit(0))).first()[0] <= MOST_MARKS
    marked = rows.select("o", "t", utf8().alias("text")).join(F.broadcast(marks) if few_marks else marks, ["o", "t"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            marks, out = batch.column("marks").to_pylist(), []
            sizes, hashes = [], []
            for x, own in zip(texts, marks, strict=True):
                media = wav(payload_of(x))
                row = [{"digest": K.digest(c), "size": len(c), "copies": 1, "data": c} for c in chunks(media)]
                for m in own or ():
                    row[m["place"]]["copies"] = m["copies"]
                    if not m["owned"]:
                        row[m["place"]]["data"] = None
                out.append(row)
                sizes.append(len(media))
                hashes.append(hashlib.sha256(media).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("t"), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(out, pa.list_(CHUNK_ARROW))], names=["o", "t", "media_bytes", "media_sha256", "chunks"])

    return written(marked.mapInArrow(run, f"o long, t long, media_bytes long, media_sha256 string, chunks array<{CHUNK}>"), "media-store")


def read_back(store: DataFrame) -> DataFrame:
    """o, t and what the stored bytes give: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Chunks that other rows own are fetched by a join on their digest; a chunk of many readers is dealt to several tasks. Media whose
    SHA-256 is not the stored one raise an error.
    """
    lacks = F.exists("chunks", lambda c: c["data"].isNull())
    salts = lambda c: F.ceil(F.col(c) / READERS).cast("int")
    wanted = store.where(lacks).select("o", "t", F.posexplode("chunks").alias("place", "c")).where("c.data is null")
    wanted = wanted.select("o", "t", "place", F.col("c.digest").alias("digest"), F.pmod(F.xxhash64("o", "t"), salts("c.copies")).cast("int").alias("salt"))
    # Only the columns beside `data` decide here, so rows without shared chunks are left where they are.
    offered = store.select(F.explode(F.filter("chunks", lambda c: (c["copies"] > 1) & c["data"].isNotNull())).alias("c"))
    offered = offered.select("c.digest", "c.data", F.explode(F.sequence(F.lit(0), salts("c.copies") - 1)).alias("salt"))
    fetched = wanted.join(offered, ["digest", "salt"]).groupBy("o", "t").agg(F.collect_list(F.struct("place", "data")).alias("fetched"))
    columns = ["o", "t", "media_bytes", "media_sha256", "chunks"]
    none = F.lit(None).cast("array<struct<place:int,data:binary>>").alias("fetched")
    whole = store.where(~lacks).select(*columns, none).unionByName(store.where(lacks).join(fetched, ["o", "t"]).select(*columns, "fetched"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices of about BLOCK_BYTES of media; a longer one is a slice of its own.
            part = np.cumsum(batch.column("media_bytes").to_numpy()) // BLOCK_BYTES
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                yield verified(batch.slice(a, b - a))

    def verified(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for row, more, size, sha in zip(*(batch.column(c).to_pylist() for c in ("chunks", "fetched", "media_bytes", "media_sha256")), strict=True):
            data = [c["data"] for c in row]
            for m in more or ():
                data[m["place"]] = m["data"]
            media = b"".join(data)
            found = hashlib.sha256(media).hexdigest()
            if (found, len(media)) != (sha, size):
                raise ValueError(f"stored media of {size} bytes do not match their digest {sha}")
            samples = samples_of(media)
            for o, v in zip(out, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), found, features(samples)), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("o"), batch.column("t"), *map(pa.array, out, kinds)], names=["o", "t", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return whole.mapInArrow(run, "o long, t long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each distinct text is stored and read once; its copies take its values. A null text is empty, an empty one has a payload of one frame of spaces.
    Rows without doc_id and repeated rows are documents like others. doc_id must be an integer (a string of digits is read as one); columns beside
    doc_id and text are not used, whatever their names. A very long text is one block of a task, its chunks are of MOST bytes at most.
    """
    rows = identified(docs)
    slim, marked = copies(rows)
    own = firsts(rows, marked)
    store = chunk_store(own.dropDuplicates(["o", "t"]) if repeats(slim) else own)
    result = written(read_back(store), "media-result")
    first = slim.groupBy("digest").agg(F.min(F.struct("o", "t")).alias("f"), F.count("*").alias("n"))
    by_text = first.select("digest", "n", F.col("f.o").alias("o"), F.col("f.t").alias("t")).join(result, ["o", "t"]).drop("o", "t")
    return dealt_join(slim, by_text, "digest", ["o", "t"], total=slim.count()).select(F.col("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
