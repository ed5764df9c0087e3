"""CSV files as records; encodings are tried in turn, which Spark's own reader can't."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EncodingUnreadable, FileCorrupt, FileEmpty
from ..scratch import swept, written

ENCODINGS = ("utf-8", "cp1252", "latin-1")
#: Fixed value: bytes of a chunk of lines, a longer line is one of its own.
CHUNK = 1 << 15
#: A line on which no quoted field is left open, begun outside of one or inside.
_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+'
_FROM_OUTSIDE = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+")
_FROM_INSIDE = re.compile(rb'(?:[^"]++|"")*+"[^,]*+(?:,' + _FIELD + rb")*+")


def records(spark: SparkSession, path: str, skip: int = 0, encodings: Sequence[str] = ENCODINGS, chunk: int = CHUNK) -> DataFrame:
    """file, row (0 = first after `skip` lines, else the number of lines after that one), cells (null if empty). The encodings have ASCII's commas, quotes and line ends.

    No task holds a file: Spark's splits become chunks of lines, each with its map of states (lines left to skip, outside of quotes, inside), and only the maps (one a chunk)
    of a file meet, to tell the state in which each chunk begins. A record, that is a line or lines joined by quotes, is bounded by a task's memory.
    """
    with swept(spark):
        lines = spark.read.text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        chunks = written(lines.mapInArrow(_chunked(skip, encodings, chunk), "file string, block long, chunk long, n long, content binary, decodes array<boolean>, ends array<int>, lasts array<int>"), "csv-chunks")
        maps = chunks.drop("content").groupBy("file").applyInArrow(_begun(skip, encodings), "file string, block long, chunk long, state int, last long, ends int, base long, open long, encoding string, closed boolean, total long")
        starts = written(maps, "csv-starts")
        bad = starts.where(F.col("encoding").isNull() | ~F.col("closed") | (F.col("total") <= skip)).limit(1).collect()
        if bad or not starts.limit(1).count():
            kind, name = (FileEmpty, path) if not bad or bad[0].total <= skip else (FileCorrupt if bad[0].encoding else EncodingUnreadable, bad[0].file)
            raise kind(name)
        both = chunks.select("file", "block", "chunk", "content").join(starts, ["file", "block", "chunk"])
        table = written(both.mapInArrow(_parsed(skip), "file string, row long, cells array<string>, block long, chunk long, piece string"), "csv-records")
    whole, pieces = table.where("piece is null"), table.where("piece is not null")
    if pieces.limit(1).count():
        parts = F.array_sort(F.collect_list(F.struct("block", "chunk", "piece")))
        joined = pieces.groupBy("file", "row").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "\n").alias("piece"))
        whole = whole.select("file", "row", "cells").unionByName(joined.mapInArrow(_reread, "file string, row long, cells array<string>"))
    return whole.select("file", "row", "cells")


def _chunked(skip: int, encodings: Sequence[str], most: int):
    def chunk_of(file: str, block: int, k: int, lines: list[bytes]) -> pa.RecordBatch:
        content = b"\n".join(lines)
        ends, lasts = _maps(lines, skip)
        return pa.RecordBatch.from_pylist([{"file": file, "block": block, "chunk": k, "n": len(lines), "content": content, "decodes": [_decodes(content, e) for e in encodings], "ends": ends, "lasts": lasts}], _CHUNKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k, held, size = None, 0, [], 0
        for batch in batches:
            file, block = batch.column("file"), batch.column("block").to_numpy()
            changes = np.flatnonzero((np.diff(file.dictionary_encode().indices.to_numpy()) != 0) | (np.diff(block) != 0)) + 1
            for a, z in pairwise([0, *changes.tolist(), len(block)] if len(block) else []):
                key = (file[a].as_py(), int(block[a]))
                if key != own:
                    if held:
                        yield chunk_of(*own, k, held)
                    own, k, held, size = key, 0, [], 0
                for line in batch.column("value").slice(a, z - a).to_pylist():
                    if held and size + len(line) > most:
                        yield chunk_of(*own, k, held)
                        k, held, size = k + 1, [], 0
                    held.append(line)
                    size += len(line) + 1
        if held:
            yield chunk_of(*own, k, held)

    return cut


_CHUNKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("decodes", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32()))])


def _decodes(content: bytes, encoding: str) -> bool:
    try:
        content.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _maps(lines: list[bytes], skip: int) -> tuple[list[int], list[int]]:
    """For each state before the lines the one after them, and the last line that begins a record (-1: none). States: lines skipped so far, skip (outside of quotes), skip + 1 (inside)."""
    before: list[int] = []

    def walk(state: int, known: tuple[int, int] | None) -> tuple[int, int]:
        last = -1
        for i, line in enumerate(lines):
            if known is None:
                before.append(state)
            elif before[i] == state:  # from here on as from outside
                return known[0], max(last, known[1] if known[1] >= i else -1)
            if state == skip:
                last = i
            if state < skip:
                state += 1
            elif b'"' in line:
                state = skip if (_FROM_INSIDE if state > skip else _FROM_OUTSIDE).fullmatch(line) else skip + 1
        return state, last

    outside = walk(skip, None)
    every = [*(walk(s, outside) for s in range(skip)), outside, walk(skip + 1, outside)]
    return [e for e, _ in every], [last for _, last in every]


def _begun(skip: int, encodings: Sequence[str]):
    def fold(chunks: pa.Table) -> pa.Table:
        """The state in which each chunk of a file begins, its first line's number and the line that began the open record."""
        t = chunks.sort_by([("block", "ascending"), ("chunk", "ascending")]).combine_chunks()
        flat = {c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in ("decodes", "ends", "lasts")}
        n, ends, lasts = t.column("n").to_numpy(), flat["ends"], flat["lasts"]
        base = np.concatenate([[0], np.cumsum(n)])
        states, opened, state, begun = np.zeros(len(n), "int32"), np.zeros(len(n), "int64"), 0, -1
        for i in range(len(n)):
            states[i], opened[i] = state, begun
            if lasts[i, state] >= 0:
                begun = base[i] + lasts[i, state]
            state = ends[i, state]
        at = np.arange(len(n))
        encoding = next((e for e, ok in zip(encodings, flat["decodes"].all(axis=0), strict=True) if ok), None)
        own = {"state": states, "last": lasts[at, states].astype("int64"), "ends": ends[at, states], "base": base[:-1], "open": opened}
        same = {"encoding": pa.array([encoding] * len(n), pa.string()), "closed": pa.array([bool(state <= skip)] * len(n)), "total": pa.array([int(base[-1])] * len(n), pa.int64())}
        return pa.table({c: t.column(c) for c in ("file", "block", "chunk")} | {c: pa.array(v) for c, v in own.items()} | same)

    return fold


def _read(lines: Iterator[str]) -> Iterator[tuple[int, list[str | None]]]:
    """The number of lines before each record, and its cells; empty lines are none."""
    reader, at = csv.reader(lines), 0
    for cells in reader:
        if cells:
            yield at, [x.strip() or None for x in cells]
        at = reader.line_num


def _parsed(skip: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, block, chunk, content, state, last, ends, base, opened, encoding = (batch.column(c)[i].as_py() for c in ("file", "block", "chunk", "content", "state", "last", "ends", "base", "open", "encoding"))
                text = content.decode(encoding)
                lines = (text if base else text.removeprefix("\ufeff")).split("\n")
                a, z = min(max(skip - state, 0), len(lines)), len(lines)
                if state > skip:  # up to the end of the record that an earlier chunk began
                    inside = content.split(b"\n")
                    a = next((k + 1 for k, x in enumerate(inside) if b'"' in x and _FROM_INSIDE.fullmatch(x)), z)
                if ends > skip:
                    z = max(a, last) if last >= 0 else a
                out = [(base + a - skip + at, cells, None) for at, cells in _read(x + "\n" for x in lines[a:z])]
                if state > skip:
                    out.append((opened - skip, None, _piece(lines[:a])))
                if ends > skip and last >= 0:
                    out.append((base + last - skip, None, _piece(lines[z:])))
                rows = {"file": pa.array([file] * len(out), pa.string()), "row": pa.array([r for r, _, _ in out], pa.int64()), "cells": pa.array([c for _, c, _ in out], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(rows | {"block": pa.array([block] * len(out), pa.int64()), "chunk": pa.array([chunk] * len(out), pa.int64()), "piece": pa.array([p for _, _, p in out], pa.string())})

    return parse


def _piece(lines: list[str]) -> str:
    """Part of a record; a cell that is longer than any can be ends the job, before its other parts are fetched."""
    text = "\n".join(lines)
    if '"' not in text and len(text) > csv.field_size_limit():
        raise csv.Error(f"field larger than field limit ({csv.field_size_limit()})")
    return text


def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [next((c for _, c in _read(x + "\n" for x in piece.split("\n"))), None) for piece in batch.column("piece").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(cells, pa.list_(pa.string()))], ["file", "row", "cells"])


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every cell as text; an empty cell is an empty text."""
    return spark.read.csv(path, header=True).na.fill("")
