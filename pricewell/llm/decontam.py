"""Benchmark decontamination: a suffix array over each shard of documents, searched for every suffix of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, masked, unmasked, utf8, written

#: Bytes of benchmark text that one pass looks for; more text takes more passes, so what is broadcast stays bounded. Items longer than
#: PIECE bytes are cut into pieces that share all but the first word of a window.
PASS_BYTES, PIECE = 8 << 20, 1 << 20
#: Rows of a place and an item that are extended at once.
MOST_ROWS = 1 << 17
#: Bits of a word's number, and numbers in a 64-bit key. 8 MB hold at most 1.7 million distinct words; more would raise an error.
ID_BITS, PER_KEY = 21, 3
MATCHES = "array<struct<item_id:string,item_word:int,doc_word:int,words:int>>"


@dataclass
class Index:
    """Benchmark items as sequences of word numbers (1 and up; 0 ends an item), and their distinct windows."""

    vocabulary: dict[bytes, int]  # each word's number
    seq: np.ndarray  # all items, each followed by a 0
    lengths: np.ndarray  # distinct windows: words,
    low: list[np.ndarray]  # the least and
    high: list[np.ndarray]  # the greatest key of a suffix that starts with it
    at: np.ndarray  # where its holders start (one more for the end)
    item: np.ndarray  # holders: an item that has the window
    start: np.ndarray  # and where in seq it has it first
    grams: np.ndarray  # sorted hashes of the first `gram` words of all windows
    gram: int
    ids: list[str]  # the items' item_ids
    first: np.ndarray  # where each item starts in seq, less the words before it in its item


def index_of(items: list[tuple[str, bytes, int]], window: int) -> Index:
    """Of (item_id, text, words before the text in its item). Items without words have no window."""
    words, cut = K.split([t for _, t, _ in items], K.SPACED)
    vocabulary: dict[bytes, int] = {}
    number = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), np.int64, len(words))
    if len(vocabulary) >= (1 << ID_BITS) - 1:
        raise ValueError(f"{len(vocabulary)} distinct words in a pass of {PASS_BYTES} bytes; take a smaller PASS_BYTES")
    parts, starts, lengths, owner, first, ids, at = [], [], [], [], [], [], 0
    for i, (key, _, before) in enumerate(items):
        own = number[cut[i] : cut[i + 1]]
        if not len(own):
            continue
        m = min(window, len(own))
        n = len(own) - m + 1
        starts.append(at + np.arange(n))
        lengths.append(np.full(n, m))
        owner.append(np.full(n, len(ids)))
        first.append(at - before)
        ids.append(key)
        parts += [own, [0]]
        at += len(own) + 1
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    seq, starts, lengths, owner = cat(parts), cat(starts), cat(lengths), cat(owner)
    gram = int(min(4, lengths.min())) if len(lengths) else 1
    grams = np.unique(_grams(seq, gram)[starts]) if len(starts) else np.zeros(0, np.uint64)
    # Windows of `window` words sort as their keys; shorter ones match any suffix between their own key filled with 0 and that filled with the largest words.
    low = _keys(seq, starts, window)
    high = [k.copy() for k in low]
    top = K.U((1 << ID_BITS) - 1)
    for j in range(window):
        short, shift = lengths <= j, K.U(ID_BITS * (PER_KEY - 1 - j % PER_KEY))
        high[j // PER_KEY][short] |= top << shift
        low[j // PER_KEY][short] &= ~(top << shift)
    order = np.lexsort([starts, owner, *low[::-1], lengths])
    differs = lambda x: np.diff(x[order].astype(np.int64), prepend=-1) != 0
    new = np.zeros(len(order), bool)
    for k in (lengths, *low):
        new |= differs(k)
    holder = order[new | differs(owner)]
    kind = np.cumsum(new)[new | differs(owner)] - 1
    one = order[new]
    return Index(vocabulary, seq, lengths[one], [k[one] for k in low], [k[one] for k in high], np.searchsorted(kind, np.arange(len(one) + 1)), owner[holder], starts[holder], grams, gram, ids, np.array(first, np.int64))


def _grams(seq: np.ndarray, k: int) -> np.ndarray:
    return K.mix(K.windows(np.concatenate([seq, np.zeros(k, np.int64)]).astype(np.uint64) + K.U(1), k))


def _keys(seq: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first `depth` words from each place, PER_KEY to a number; less than the depth is filled with 0."""
    padded = np.concatenate([seq, np.zeros(depth + PER_KEY, np.int64)]).astype(np.uint64)
    out = []
    for k in range(0, depth, PER_KEY):
        key = np.zeros(len(at), np.uint64)
        for j in range(k, k + PER_KEY):
            key = (key << K.U(ID_BITS)) | (padded[at + j] if j < depth else K.U(0))
        out.append(key)
    return out


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], upper: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: how many suffixes sort before each (or before and at it)."""
    n = len(wanted[0])
    low, high = np.zeros(n, np.int64), np.full(n, len(keys[0]), np.int64)
    while (live := low < high).any():
        mid = (low + high) >> 1
        probe = np.minimum(mid, len(keys[0]) - 1)
        before, same = np.zeros(n, bool), np.ones(n, bool)
        for k, w in zip(keys, wanted, strict=True):
            x = k[probe]
            before |= same & (x < w)
            same &= x == w
        go = live & (before | same if upper else before)
        low, high = np.where(go, mid + 1, low), np.where(live & ~go, mid, high)
    return low


@dataclass
class Found:
    """What a block's searches found: each text's words, the places of windows as rows [text, first word, end], and the first place of each window in each text."""

    n_words: np.ndarray
    spans: np.ndarray
    seq: np.ndarray  # the words of all texts, a 0 after each
    where: np.ndarray  # places of the words in seq
    cut: np.ndarray  # words before each text
    text: np.ndarray  # of the first places, ascending
    window: np.ndarray
    place: np.ndarray


def search(texts: list[bytes], index: Index, window: int) -> Found:
    """Searches the suffix array of a block of texts for every distinct window of the benchmark.

    A prefilter leaves suffixes out of the shard's array whose first words start no window. A binary search for a window can end only at
    suffixes that start with the window's words, so these are all it needs. Words are compared themselves: their numbers come from a dictionary.
    """
    words, cut = K.split(texts, K.SPACED)
    n_words = np.diff(cut)
    none = np.zeros(0, np.int64)
    nothing = Found(n_words, np.zeros((0, 3), np.int64), none, none, cut, none, none, none)
    if not len(words) or not len(index.lengths):
        return nothing
    doc = np.repeat(np.arange(len(texts)), n_words)
    seq = np.zeros(len(words) + len(texts), np.int64)  # a 0 after each text
    where = np.arange(len(words)) + doc
    seq[where] = np.fromiter((index.vocabulary.get(w, 0) for w in words), np.int64, len(words))
    suffixes = where[seq[where] > 0]
    g = _grams(seq, index.gram)[suffixes]
    near = np.minimum(np.searchsorted(index.grams, g), len(index.grams) - 1)
    suffixes = suffixes[index.grams[near] == g]
    if not len(suffixes):
        return nothing
    keys = _keys(seq, suffixes, window)
    order = np.lexsort(keys[::-1])
    array, keys = suffixes[order], [k[order] for k in keys]
    low, high = _bound(keys, index.low, False), _bound(keys, index.high, True)
    hit, p = _spread(np.arange(len(low)), high - low)
    if not len(hit):
        return nothing
    p = array[low[hit] + p]
    own = np.searchsorted(where, p)
    d = doc[own]
    word = own - cut[d]
    spans = np.stack([d, word, word + index.lengths[hit]], axis=1)
    order = np.lexsort([p, hit, d])
    once = order[(np.diff(d[order], prepend=-1) != 0) | (np.diff(hit[order], prepend=-1) != 0)]
    return Found(n_words, spans[np.argsort(d, kind="stable")], seq, where, cut, d[once], hit[once], p[once])


def extended(found: Found, index: Index, part: np.ndarray) -> list[np.ndarray]:
    """Maximal verbatim matches as [text, item, item's word, text's word, words] of some first places, each against every item that has its window.

    The places and the items that meet are cut into slices of MOST_ROWS; of a slice only the longest match of each text and item is kept.
    """
    best = [np.zeros(0, np.int64)] * 5
    held = np.diff(index.at)[found.window[part]]
    upto = np.concatenate([[0], np.cumsum(held)])
    for low in range(0, int(upto[-1]), MOST_ROWS):
        row = np.arange(low, min(low + MOST_ROWS, int(upto[-1])))
        k = np.searchsorted(upto, row, "right") - 1
        holder = index.at[found.window[part[k]]] + row - upto[k]
        k = part[k]
        new = _maximal(found, index, found.text[k], found.place[k].copy(), index.item[holder], index.start[holder].copy(), index.lengths[found.window[k]].copy())
        best = _best([np.concatenate(x) for x in zip(best, new, strict=True)])
    return best


def _best(m: list[np.ndarray]) -> list[np.ndarray]:
    """By text and item the longest match, of equal ones the first in the text, then in the item."""
    d, item, item_word, doc_word, length = m
    order = np.lexsort([item_word, doc_word, -length, item, d])
    one = order[(np.diff(d[order], prepend=-1) != 0) | (np.diff(item[order], prepend=-1) != 0)]
    return [x[one] for x in m]


def _maximal(found: Found, index: Index, d: np.ndarray, p: np.ndarray, item: np.ndarray, t: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    seq = found.seq
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] - 1, t[live] - 1
        live = live[(a >= 0) & (b >= 0) & (seq[np.maximum(a, 0)] == index.seq[np.maximum(b, 0)]) & (seq[np.maximum(a, 0)] > 0)]
        p[live] -= 1
        t[live] -= 1
        length[live] += 1
    tail, goal = np.append(seq, 0), np.append(index.seq, 0)
    live = np.arange(len(p))
    while len(live):
        a, b = tail[p[live] + length[live]], goal[t[live] + length[live]]
        live = live[(a == b) & (a > 0)]
        length[live] += 1
    return [d, item, t - index.first[item], np.searchsorted(found.where, p) - found.cut[d], length]


def _spread(of: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value so many times, and the number of the repetition."""
    return np.repeat(of, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, text, before (words of the item before the text): items cut into pieces of PIECE bytes, about, each distinct one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            ids, pieces, before = [], [], []
            for key, text in zip(batch.column("item_id").to_pylist(), texts, strict=True):
                words, at = text.translate(K.SPACED).split(), 0
                while at < len(words):
                    size, end = 0, at
                    while end < len(words) and (size < PIECE or end - at < window):
                        size += len(words[end]) + 1
                        end += 1
                    ids.append(key)
                    pieces.append(b" ".join(words[at:end]))
                    before.append(at)
                    if end == len(words):
                        break
                    at = end - window + 1
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "text": pa.array(pieces, pa.binary()), "before": pa.array(before, pa.int64())})

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), utf8().alias("text"))
    return written(rows.mapInArrow(run, "item_id string, text binary, before long").distinct(), "bench")


def _passes(pieces: DataFrame) -> Iterator[list[tuple[str, bytes, int]]]:
    """Lists of pieces of at most PASS_BYTES together; one list is in the driver at a time."""
    held: list[tuple[str, bytes, int]] = []
    size = 0
    for r in pieces.toLocalIterator():
        n = len(r.text) + 1
        if held and size + n > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, bytes(r.text), r.before))
        size += n
    yield held


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Adds n_words, hits (array of [start, end) in words, merged) and matches to the docs.

    matches has the longest maximal verbatim match of at least a window for each item_id that has one, with its places in item and document (the
    first of several). Null and empty texts have no words; benchmark rows without words match nothing, a null item_id reads as an empty string.
    Repeated item rows are one, rows of one item_id with other texts count as that item. Repeated rows of docs are documents of their own, a very long
    text is one block of a task. Columns named as the new ones are replaced, others pass.

    One pass over the docs is enough for PASS_BYTES of benchmark. More passes read a written copy of the docs and write only what they find.
    """
    own = docs.drop("n_words", "hits", "matches")
    empty = {"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<array<int>>"), "matches": F.array().cast(MATCHES)}
    passes = _passes(_pieces(benchmark, window))
    first, second = next(passes), next(passes, None)
    if second is None:
        return _scan(own.withColumns(empty), index_of(first, window), window)
    kept = written(own.withColumn("_row", F.monotonically_increasing_id()), "bench-docs")
    texts = kept.select("_row", "text").withColumns(empty)
    parts, words = [], None
    for items in chain([first, second], passes):
        seen = _scan(texts, index_of(items, window), window).select("_row", "n_words", "hits", "matches")
        seen = written(seen if words is None else seen.where(F.size("hits") > 0), "bench-pass")
        words = seen.select("_row", "n_words") if words is None else words
        parts.append(seen.where(F.size("hits") > 0).select("_row", "hits", "matches"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    # A row a pass at most.
    gathered = every.groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))
    joined = words.join(gathered.mapInArrow(_gather, f"_row long, hits array<array<int>>, matches {MATCHES}"), "_row", "left")
    joined = joined.select("_row", "n_words", F.coalesce("hits", empty["hits"]).alias("hits"), F.coalesce("matches", empty["matches"]).alias("matches"))
    return kept.join(joined, "_row").drop("_row")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            hits, matches = _merged(batch.column("hits")[i].as_py()), _longest(batch.column("matches")[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("_row").slice(i, 1), pa.array([hits], batch.schema.field("hits").type), pa.array([matches], batch.schema.field("matches").type)], schema=batch.schema)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _portions(found: Found, index: Index, texts: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of texts [a, b) and their first places, so that places times items of a run are MOST_ROWS about; one text may have more."""
    held = np.diff(index.at)[found.window]
    per_text = np.bincount(found.text, held, texts)
    a, size = 0, 0.0
    for b in range(1, texts + 1):
        size += per_text[b - 1]
        if b == texts or size + per_text[b] > MOST_ROWS:
            yield a, b, np.arange(*np.searchsorted(found.text, [a, b]))
            a, size = b, 0.0


def _scan(docs: DataFrame, index: Index, window: int) -> DataFrame:
    """Fills n_words, hits and matches of one pass. A portion of a block leaves a task before the next one's matches are made."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in blocks(batches):
            found = search(texts, own, window)
            for a, b, part in _portions(found, own, len(texts)):
                columns = {c: batch.column(c).slice(a, b - a) for c in batch.schema.names}
                columns["n_words"] = pa.array(found.n_words[a:b], pa.int64())
                if len(part):
                    hits: list[list] = [[] for _ in range(a, b)]
                    matches: list[list] = [[] for _ in range(a, b)]
                    for d, item, item_word, doc_word, length in zip(*(x.tolist() for x in extended(found, own, part)), strict=True):
                        matches[d - a].append({"item_id": own.ids[item], "item_word": item_word, "doc_word": doc_word, "words": length})
                    low, high = np.searchsorted(found.spans[:, 0], [a, b])
                    for d, start, end in found.spans[low:high].tolist():
                        hits[d - a].append([start, end])
                    columns["hits"] = pa.array([_merged(x) for x in hits], batch.schema.field("hits").type)
                    columns["matches"] = pa.array([_longest(x) if len(x) > 1 else x for x in matches], batch.schema.field("matches").type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], schema=batch.schema)

    return docs.mapInArrow(scan, schema)


def _longest(matches: list[dict]) -> list[dict]:
    """One match an item_id; pieces, passes and rows of one item_id may have given several."""
    best: dict[str, dict] = {}
    for m in matches:
        old = best.get(m["item_id"])
        if old is None or (-m["words"], m["doc_word"], m["item_word"]) < (-old["words"], old["doc_word"], old["item_word"]):
            best[m["item_id"]] = m
    return [best[k] for k in sorted(best)]


def document_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row a document, repeated rows each. A null or empty text has no words and no items."""
    found = find(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x[1] - x[0])).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, all columns as they were."""
    rows = masked(docs, "text").drop(f"c{docs.columns.index('text')}")
    return unmasked(find(rows, benchmark).where(F.size("hits") == 0), docs.columns, text="text")
