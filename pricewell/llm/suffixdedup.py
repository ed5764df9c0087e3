"""Suffix-array dedup: bytes of strings that occur again go. Suffixes are sorted one bucket at a time; long ties are resolved by the ranks of a difference cover."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, narrow_join, utf8, written
from .regions import Spec, copies, emit, firsts, identified, regions_of, repeats, spread_of

SPEC = Spec("bytes", 200, 32)
#: The cover's period. Suffixes are told apart by their first PERIOD bytes, then by ranks of cover places (RANKED bytes deep), then by the last bytes.
PERIOD, RANKED = 32, 160
#: Bytes of regions that one block sorts, about; a bucket of more regions than MOST_REGIONS is split by longer sampled grams, of GRAMS bytes in turn.
BLOCK, MOST_REGIONS = 1 << 20, 2048
GRAMS = (64, 128, 200)


def _cover(period: int) -> list[int]:
    """A set of residues whose differences give every residue; built greedily."""
    out, have = [0], {0}
    while len(have) < period:
        best = max((x for x in range(period) if x not in out), key=lambda x: (len(have | {(x - y) % period for y in out} | {(y - x) % period for y in out}), -x))
        have |= {(best - y) % period for y in out} | {(y - best) % period for y in out}
        out.append(best)
    return sorted(out)


COVER = np.zeros(PERIOD, bool)
COVER[_cover(PERIOD)] = True
#: SHIFT[a, b]: the least d for which a + d and b + d are both in the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if COVER[(a + d) % PERIOD] and COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """The rank of each row of keys, equal for equal rows, from 1."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ranks as one key."""
    return (a << np.int64(32)) | b


class Block:
    """Some regions laid out in one text, whose windows' suffixes are sorted to `length` bytes.

    Each region is shifted so that its sampled gram (at `at`) starts at a multiple of the period: equal windows then stand alike to the cover.
    """

    def __init__(self, regions: list[bytes], length: int, at: list[int] | None = None) -> None:
        self.length = length
        size, gram = np.array([len(x) for x in regions]), np.array(at or [0] * len(regions))
        before = np.concatenate([[0], (size - gram)[:-1]])
        pad = -(before + gram) % PERIOD
        self.at = np.cumsum(pad + size) - size
        body = np.frombuffer(b"".join([x for k, r in zip(pad.tolist(), regions, strict=True) for x in (bytes(k), r)] + [bytes(PERIOD)]), np.uint8)
        word = body.astype(np.uint64)
        for bits in (8, 16, 32):  # eight bytes from each place as a big-endian number
            step = bits // 8
            word = np.concatenate([(word[:-step] << K.U(bits)) | word[step:], np.zeros(step, np.uint64)])
        self.text, self.word = body, word
        n = size - length + 1
        self.region = np.repeat(np.arange(len(regions)), n)
        self.offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.suffix = self.at[self.region] + self.offset
        total = int(self.at[-1] + size[-1])
        left = np.zeros(total, np.int64)  # bytes to the region's end
        inside = np.repeat(self.at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        left[inside] = np.repeat(self.at + size, size) - inside
        self.rank = self._ranks(left)

    def _words(self, p: np.ndarray, first: int, last: int) -> list[np.ndarray]:
        return [self.word[p + k] for k in range(first, last, 8)]

    def _ranks(self, left: np.ndarray) -> np.ndarray:
        """Ranks by RANKED bytes of the cover's places, by doubling; 0 elsewhere."""
        total = len(left)
        place = np.flatnonzero(COVER[np.arange(total) % PERIOD] & (left >= PERIOD))
        rank, depth = np.zeros(total + 1, np.int64), PERIOD
        rank[place] = _dense(self._words(place, 0, PERIOD))
        base = rank
        while depth < RANKED:
            step = min(depth, RANKED - depth)
            place = place[left[place] >= depth + step]
            nxt = np.zeros_like(rank)
            nxt[place] = _dense([_pair(rank[place], (rank if step == depth else base)[place + depth])])
            rank, depth = nxt, depth + step
        return rank

    def _compare(self, i: int, j: int) -> int:
        """Of two suffixes with the same first PERIOD bytes."""
        d = int(SHIFT[i % PERIOD, j % PERIOD])
        a, b = self.rank[i + d], self.rank[j + d]
        if a != b:
            return -1 if a < b else 1
        x, y = (self.text[k + RANKED : k + self.length].tobytes() for k in (i, j))
        return (x > y) - (x < y)

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix its rank by the first PERIOD bytes, and its rank by all among those of equal first bytes (0 where it is the only one)."""
        p = self.suffix
        head = _dense(self._words(p, 0, PERIOD))
        idx = np.flatnonzero(np.bincount(head)[head] > 1)
        q = p[idx]
        res = q % PERIOD
        near = _dense([_pair(head[idx] * PERIOD + res, self.rank[q + SHIFT[res, res]])])  # of one residue: the next place of the cover decides
        cls = _dense([near, *self._words(q, RANKED, self.length)])
        # Classes of one head that stand to the cover in several ways are put in order by comparing one suffix of each.
        top = int(cls.max(initial=0))
        reps, group = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
        reps[cls], group[cls] = q, head[idx]
        place = np.arange(top + 1)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        how = reps % PERIOD
        mixed = np.minimum.reduceat(how, cuts) != np.maximum.reduceat(how, cuts)
        for a, b in zip(cuts[mixed].tolist(), np.append(cuts[1:], top + 1)[mixed].tolist(), strict=True):
            ranked = sorted(range(a, b), key=cmp_to_key(lambda x, y: self._compare(int(reps[x]), int(reps[y]))))
            level = a
            for k, x in enumerate(ranked):
                if k and self._compare(int(reps[ranked[k - 1]]), int(reps[x])):
                    level = a + k
                place[x] = level
        out = np.zeros(len(p), np.int64)
        out[idx] = place[cls]
        return head, out

    def repeated(self) -> np.ndarray:
        """For each suffix: another one has its rank, so it shares `length` bytes with a neighbour in the order."""
        _, rank = self.ranks()
        times = np.bincount(rank)
        times[0] = 1
        return times[rank] > 1


def _bodies(spec: Spec, text: bytes, start: np.ndarray, size: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Digests of the regions' bytes, and the bytes."""
    own = [text[a : a + n + spec.length - 1] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    return [K.digest(x) for x in own], own


def _packed(pos: int, mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    a, b = K.runs(mask)
    return [(pos + int(x), pos + int(y) + length - 1) for x, y in zip(a, b, strict=True)]


SPANS = "o long, t long, spans array<struct<pos:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("end", pa.int32())]))


BUCKET = ["o", "t", "pos", "sample", "digest", "inner", "at", "body"]


def _batch(rows: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    o, t, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"o": pa.array(o, pa.int64()), "t": pa.array(t, pa.int64()), "spans": pa.array([[{"pos": a, "end": b} for a, b in s] for s in spans], SPANS_ARROW)})


def sort_buckets(regions: DataFrame, length: int) -> DataFrame:
    """o, t, spans of the repeated windows. One bucket holds the suffixes of one sample, a block some whole buckets.

    A bucket's rows come by digest: equal regions are laid out once. A region that occurs again is repeated whole; the windows of the others
    are told by the sorted suffixes of all the bucket's distinct regions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[tuple | None, bytes, int]] = []  # the only occurrence of a region, or none; its bytes; its sampled gram's place
        out: list[tuple[int, int, list[tuple[int, int]]]] = []
        held: list[tuple] = []  # of one bucket: body, inner, occurrences, place of the sampled gram
        last: tuple = (None, None)
        size = 0
        for batch in batches:
            for o, t, pos, sample, digest, inner, at, body in zip(*(batch.column(c).to_pylist() for c in BUCKET), strict=True):
                if sample != last[0]:
                    size += close(held, block, out)
                    held = []
                    if size > BLOCK:
                        flush(block, out)
                        block, size = [], 0
                if (sample, digest) != last:
                    held.append((body, inner, [], at))
                    last = (sample, digest)
                held[-1][2].append((o, t, pos))
            if len(out) > 4096:
                yield _batch(out)
                out = []
        close(held, block, out)
        flush(block, out)
        if out:
            yield _batch(out)

    def close(held: list[tuple], block: list, out: list) -> int:
        for body, _, places, _ in held:
            if len(places) > 1:
                out += [(o, t, [(pos, pos + len(body))]) for o, t, pos in places]
        single = [h for h in held if len(h[2]) == 1]
        if not single or (len(held) == 1 and not single[0][1]):
            return 0
        block += [(h[2][0] if len(h[2]) == 1 else None, h[0], h[3]) for h in held]
        return sum(len(h[0]) for h in held)

    def flush(rows: list, out: list) -> None:
        if not rows:
            return
        block = Block([r[1] for r in rows], length, [r[2] for r in rows])
        hit = block.repeated()
        ends = np.cumsum(np.bincount(block.region, minlength=len(rows)))
        starts = np.concatenate([[0], ends[:-1]])
        for k in np.flatnonzero(np.add.reduceat(hit, starts) > 0):
            if rows[k][0] is not None:
                o, t, pos = rows[k][0]
                out.append((o, t, _packed(pos, hit[starts[k] : ends[k]], length)))

    return regions.select(*BUCKET).repartition("sample").sortWithinPartitions("sample", "digest", "o", "t", "pos").mapInArrow(run, SPANS)


def _split(regions: DataFrame, spec: Spec) -> DataFrame:
    """The same windows in regions of a longer sampled gram. Equal windows have the same longer sample too, so they meet again."""
    schema = "o long, t long, pos int, m int, sample long, digest binary, inner boolean, at int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in blocks(batches, "body"):
            out: list[list] = [[] for _ in range(9)]
            for o, t, pos, body in zip(*(batch.column(c).to_pylist() for c in ("o", "t", "pos")), bodies, strict=True):
                values = K.TABLE[np.frombuffer(body, np.uint8)]
                start, size, sample, grams = regions_of(spec, values)
                digests, own = _bodies(spec, body, start, size)
                spread = spread_of(grams)
                for a, n, x, d, b in zip(start.tolist(), size.tolist(), sample, digests, own, strict=True):
                    same = spread[a : a + n + spec.length - spec.gram] == x
                    for c, v in zip(out, (o, t, pos + a, n, int(x.view(np.int64)), d, int(np.count_nonzero(same)) > 1, int(same.argmax()), b), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["o", "t", "pos", "m", "sample", "digest", "inner", "at", "body"])

    return regions.select("o", "t", "pos", "body").mapInArrow(run, schema)


def _spans(found: DataFrame, spec: Spec, grams: tuple[int, ...]) -> DataFrame:
    """o, t, spans of the repeated windows of regions.

    Counts of equal regions combine before the shuffle and tell which buckets are too large to be sorted at once. Of these, equal regions
    collapse first: all occurrences but those of a region that occurs once are repeated whole (told by their places, so a frequent region is no
    skew). The distinct ones are split into buckets of a longer gram, and so on; with the last, a bucket's windows have one hash of all their bytes.
    """
    key = ["o", "t", "pos"]
    distinct = written(found.groupBy("sample", "digest").agg(F.count("*").alias("n"), F.min(F.struct(*key)).alias("f")), "suffix-distinct")
    large = written(distinct.groupBy("sample").agg(F.sum("n").alias("rows")).where(F.col("rows") > MOST_REGIONS).select("sample"), "suffix-large")
    if not large.limit(1).count():
        return sort_buckets(found, spec.length)
    small = sort_buckets(narrow_join(found, large, "sample", "left_anti"), spec.length)
    often = narrow_join(found, large, "sample", "left_semi")
    first = written(narrow_join(distinct, large, "sample", "left_semi").select("n", "f.*"), "suffix-firsts")
    whole = often.select(*key, "m").join(first.where("n = 1").select(*key), key, "left_anti")
    whole = whole.select("o", "t", F.array(F.struct("pos", (F.col("pos") + F.col("m") + (spec.length - 1)).cast("int").alias("end"))).alias("spans"))
    own = often.join(first.select(*key), key, "left_semi")
    if grams:
        longer = Spec(spec.unit, spec.length, grams[0])
        rest = _spans(written(_split(own, longer), "suffix-split"), longer, grams[1:])
    else:
        rest = sort_buckets(own, spec.length)
    return small.unionByName(whole).unionByName(rest)


def repeated_spans(rows: DataFrame, slim: DataFrame, marked: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """o, t, spans: (start, end) in bytes of all windows that occur more than once among the distinct texts."""
    units = slim.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    found = written(emit(firsts(rows, marked), spec, units, "body", _bodies), "suffix-regions")
    spans = _spans(found, spec, GRAMS)
    return written(spans.groupBy("o", "t").agg(F.flatten(F.collect_list("spans")).alias("spans")), "suffix-spans")


#: Spans (of eight bytes) that may be broadcast to the texts; with more, texts and spans are shuffled.
MOST_SPANS = 2_000_000


def remove_repeats(docs: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left).

    A byte goes if a string of 200 bytes that covers it starts anywhere else too. Texts are compared as UTF-8, matches stay in a document;
    a null text is empty. Rows of one text are copies of each other, repeated rows too, whatever their doc_id (null ones too). doc_id must be an
    integer (a string of digits is read as one); columns beside doc_id and text are not used, whatever their names. A very long text is one block.
    """
    rows = identified(docs)
    slim, marked = copies(rows)
    # A row that is repeated as a whole has one (o, t): its group of copies may consist of nothing else.
    spans = repeated_spans(rows.dropDuplicates(["o", "t"]) if repeats(slim) else rows, slim, marked, spec)
    few_spans = spans.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0] <= MOST_SPANS
    full = narrow_join(rows.withColumn("text", utf8()), marked, ["o", "t"], "left").join(F.broadcast(spans) if few_spans else spans, ["o", "t"], "left").select("doc_id", "text", F.col("copy").isNotNull().alias("copied"), "spans")
    length = spec.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            copied, spans = batch.column("copied").to_pylist(), batch.column("spans").to_pylist()
            out: list[list] = [[], [], [], []]
            for x, c, s in zip(texts, copied, spans, strict=True):
                n, gone, kept = (0, 0, x)
                if c and len(x) >= length:
                    n, gone, kept = 1, len(x), b""
                elif s:
                    d = np.zeros(len(x) + 1, np.int32)
                    at = np.array([(a["pos"], a["end"]) for a in s])
                    np.add.at(d, at[:, 0], 1)
                    np.add.at(d, at[:, 1], -1)
                    mask = np.cumsum(d[:-1]) > 0
                    n, gone, kept = len(K.runs(mask)[0]), int(mask.sum()), np.frombuffer(x, np.uint8)[~mask].tobytes()
                for o, v in zip(out, (len(x), gone, n, kept), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return full.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


def document_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
