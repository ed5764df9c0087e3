"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_ROWS, GROUP_ROWS, blocks, dealt_join, few, masked, narrow_join, unmasked, utf8, written
from .components import components
from .regions import NO_ID, identified, repeats


#: Shingles of a block of a crowded bucket, about; rounds of further centers before the pairs left are compared.
BLOCK_SHINGLES, ROUNDS = 1 << 18, 1


@dataclass(frozen=True)
class Spec:
    """Shingles of `words` words; documents are linked at a Jaccard similarity of `percent` or more.

    128 bins in 32 bands of 4: two sets at 0.8 share a bucket with probability 1 - 5e-8, and about 13 of them.
    """

    words: int = 5
    percent: int = 80
    bins: int = 128
    rows: int = 4


def shingle_sets(spec: Spec, texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; the whole sequence where there are fewer words; empty without words."""
    h, at = K.word_hashes([x.translate(K.LOWER) for x in texts])
    out = []
    for i in range(len(texts)):
        own = h[at[i] : at[i + 1]]
        k = min(spec.words, len(own))
        out.append(np.unique(K.mix(K.windows(own, k) + K.U(k))) if k else own)
    return out


def exact_sets(spec: Spec, texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted numbers, which are equal within this call only for shingles of the same words."""
    words, at = K.split(texts, K.LOWER)
    ids = K.numbered(words)
    codes = K.classes(ids, spec.words)
    short: dict[bytes, int] = {}
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= spec.words:
            out.append(np.unique(codes[a : b - spec.words + 1]))
        else:  # fewer words are one shingle, unlike any longer one
            key = ids[a:b].tobytes()
            out.append(np.array([-1 - short.setdefault(key, len(short))] if b > a else [], np.int64))
    return out


def signature(spec: Spec, shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of the first full bin on its own fixed random walk over the bins."""
    shift = K.U(64 - spec.bins.bit_length() + 1)
    first = np.searchsorted(shingles, np.arange(spec.bins, dtype=np.uint64) << shift)
    out = shingles[np.minimum(first, len(shingles) - 1)]
    full = (first < len(shingles)) & ((out >> shift) == np.arange(spec.bins, dtype=np.uint64))
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        turn += 1
        to = (K.mix(empty.astype(np.uint64) * K.U(K.P) + K.U(turn)) % K.U(spec.bins)).astype(np.int64)
        ok = full[to]
        out[empty[ok]] = out[to[ok]]
        empty = empty[~ok]
    return out


def bands(spec: Spec, sig: np.ndarray) -> np.ndarray:
    """A bucket for each band; buckets of different bands differ."""
    rows = sig.reshape(-1, spec.rows)
    key = np.arange(len(rows), dtype=np.uint64)
    for j in range(spec.rows):
        key = K.mix(key * K.U(K.P) + rows[:, j])
    return key.view(np.int64)


def signed(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, o, t (which tell rows apart, see `identified`), n_shingles, digest (of the set; null if it is empty), buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sets = shingle_sets(spec, texts)
            keys = [bands(spec, signature(spec, x)) if len(x) else None for x in sets]
            digest = [K.digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "o", "t")), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "o", "t", "n_shingles", "digest", "buckets"],
            )

    rows = identified(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "o", "t", utf8().alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, o long, t long, n_shingles long, digest binary, buckets array<long>"), "minhash-sets")


@dataclass(frozen=True)
class Texts:
    """The text of each node: that of the row (o, t) which stands for its set."""

    docs: DataFrame
    nodes: DataFrame  # node, o, t
    repeated: bool  # some rows are alike in (o, t)

    def of(self, wanted: DataFrame) -> DataFrame:
        """node, text of the wanted nodes (distinct), as a written table."""
        some = written(self.nodes.join(wanted, "node", "left_semi"), "minhash-nodes")
        rows = narrow_join(identified(self.docs).select("o", "t", utf8().alias("text")), some, ["o", "t"]).select("node", "text")
        return written(rows.dropDuplicates(["node"]) if self.repeated else rows, "minhash-texts")


def rays(edges: DataFrame) -> DataFrame:
    """node, centers: the centers that a node has edges to, and itself if it is one, in lists of GROUP_ROWS at most."""
    ends = edges.select("node", "center").union(edges.select("center", F.col("center").alias("_same")).distinct())
    place = F.row_number().over(W.partitionBy("node").orderBy("center")) - 1
    return ends.withColumn("_list", F.floor(place / GROUP_ROWS)).groupBy("node", "_list").agg(F.collect_list("center").alias("centers")).drop("_list")


def confirmed(edges: DataFrame, texts: Texts, spec: Spec) -> DataFrame:
    """The edges (center, node) whose full sets of shingles are similar enough, as u < v; words are compared, not hashes.

    A text meets the list of centers that it goes to, which is broadcast while edges are few, so that each edge carries one text through one shuffle, and
    each center one more. A center of many edges is dealt to several tasks.
    """
    edges = written(edges, "minhash-edges")
    counts = written(edges.groupBy("center").agg(F.count("*").alias("n")), "minhash-rays")
    own = texts.of(edges.select("node").union(edges.select("center")).distinct())
    # Rows with lists are broadcast up to half as many edges as rows of nodes, so that no more is broadcast at once than for their texts.
    lists = written(rays(edges), "minhash-lists")
    listed = narrow_join(own, lists, "node", most=BROADCAST_ROWS if few(edges, BROADCAST_ROWS // 2) else 0)
    carried = listed.select(F.explode("centers").alias("center"), "node", F.col("text").alias("a")).where("center <> node")
    middle = listed.where(F.array_contains("centers", F.col("node"))).select(F.col("node").alias("center"), F.col("text").alias("b"))
    two = dealt_join(carried, middle, "center", ["node"], counts=counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "a"):
            centers, others = batch.column("center").to_pylist(), batch.column("b")
            place = {c: len(texts) + k for k, c in enumerate(dict.fromkeys(centers))}
            first = {c: i for i, c in reversed(list(enumerate(centers)))}
            sets, ok = exact_sets(spec, texts + [others[first[c]].as_py() for c in place]), []
            for x, c in zip(sets, centers, strict=False):
                y = sets[place[c]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= spec.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("center"), batch.column("node")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    found = two.select("center", "node", "a", "b").mapInArrow(run, "u long, v long")
    return written(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "minhash-links")


def _similar(spec: Spec, sets: list[np.ndarray], group: np.ndarray, lone: np.ndarray, half: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of similar sets of different groups, at least one of them lone and not both of half 0 or both of half 2; a forest over the groups."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    sets, size = [sets[i] for i in order], size[order]
    group, lone, half = group[order], lone[order], half[order]
    flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    parent: dict[int, int] = {}

    def top(g: int) -> int:
        while parent.get(g, g) != g:
            parent[g] = g = parent.get(parent[g], parent[g])
        return g

    own, k = np.flatnonzero(lone), 0
    while k < len(own):
        # Rows of one chunk: 16,384 shingles or 64 rows at most.
        n = max(1, min(64, int(np.searchsorted(np.cumsum(size[own[k : k + 64]]), 16_384, "right"))))
        rows, k = own[k : k + n], k + n
        lo = int(np.searchsorted(size * 100, spec.percent * size[rows[0]], "left"))
        hi = int(np.searchsorted(size * spec.percent, size[rows[-1]] * 100, "right"))
        kinds, place = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
        table = np.zeros((len(kinds), n), np.int32)
        table[place, np.repeat(np.arange(n), size[rows])] = 1
        at = lo
        while at < hi:
            # Others of one step: 65,536 shingles or one row.
            end = min(hi, max(at + 1, int(np.searchsorted(start, start[at] + 65_536, "right")) - 1))
            part = flat[start[at] : start[end]]
            col = np.minimum(np.searchsorted(kinds, part), len(kinds) - 1)
            hit = kinds[col] == part
            upto = np.concatenate([[0], np.cumsum(hit)])[start[at : end + 1] - start[at]]
            both = np.zeros((end - at, n), np.int64)
            full = np.flatnonzero(np.diff(upto))
            if len(full):
                both[full] = np.add.reduceat(table[col[hit]], upto[:-1][full], axis=0)
            ok = (both > 0) & (100 * both >= spec.percent * (size[at:end, None] + size[rows][None, :] - both)) & (group[at:end, None] != group[rows][None, :]) & (half[at:end, None] + half[rows][None, :] != 0) & (half[at:end, None] + half[rows][None, :] != 4)
            for j, i in np.argwhere(ok):
                a, b = top(int(group[at + j])), top(int(group[rows[i]]))
                if a != b:
                    parent[a] = b
                    yield int(order[at + j]), int(order[rows[i]])
            at = end


def compared(rest: DataFrame, texts: Texts, spec: Spec) -> DataFrame:
    """Similar pairs (u, v) of different components within a bucket, enough of them to join these components; rest has bucket, node, component.

    All pairs of a bucket are compared but those within its largest component. The full sets meet in units of at most two blocks of about BLOCK_SHINGLES;
    a bucket of k blocks has k (k + 1) / 2 units, so that no task holds a large bucket. The pairs themselves are no rows.
    """
    own = texts.of(rest.select("node").distinct())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in shingle_sets(spec, texts)], pa.binary())], names=["node", "shingles"])

    own = written(own.mapInArrow(make, "node long, shingles binary"), "minhash-sets")
    sized = rest.join(own.select("node", (F.length("shingles") / 8).cast("long").alias("size")), "node")
    each = sized.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    whole = each.groupBy("bucket").agg(F.max_by("component", F.struct("rows", -F.col("component"))).alias("most"), F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.sum("rows").alias("n"))
    put = dealt_join(rest, whole, "bucket", ["node"], total=rest.count()).select("bucket", "node", "component", (F.col("component") != F.col("most")).alias("lone"), "blocks", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int").alias("b"))
    put = put.withColumn("x", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    put = put.select("bucket", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "node", "component", "lone")
    # Units whose rows are all of one component have nothing to compare.
    put = written(put, "minhash-units")
    useful = put.groupBy("bucket", "i", "j").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("bucket", "i", "j")
    units = put.join(useful, ["bucket", "i", "j"]).join(own, "node")
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            node, i, j, b = (rows.column(c).to_numpy() for c in ("node", "i", "j", "b"))
            # Halves: 0 and 2 for the two blocks, 1 where a unit is one block, so that sums of 0 and 4 are pairs of one block.
            half = np.where(i == j, 1, np.where(b == i, 0, 2))
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            pairs = list(_similar(spec, sets, rows.column("component").to_numpy(), rows.column("lone").to_numpy(), half))
            u, v = (node[[p[k] for p in pairs]] if pairs else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(c).to_numpy() for c in keys])
            cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for s, e in zip(cut, cut[1:], strict=False):
                key = tuple(cols[:, s])
                if held and key != last:
                    yield close(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = key
        if held:
            yield close(held)

    dealt = units.repartition(*keys).sortWithinPartitions(*keys)
    pairs = dealt.select(*keys, "b", "node", "component", "lone", "shingles").mapInArrow(run, "u long, v long").distinct()
    return confirmed(pairs.select(F.col("u").alias("center"), F.col("v").alias("node")), texts, spec)


def _linked(reps: DataFrame, texts: Texts, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """The confirmed links (u, v) of the nodes, and their components."""
    held = reps.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"))  # a node is one row
    shared = held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    members = written(dealt_join(held, shared, "bucket", ["node"]), "minhash-members")
    total = members.count()
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = written(members.join(weight, "node").select("bucket", "node", "weight"), "minhash-members")
    center = members.groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("center"), F.count("*").alias("n"))
    tried = written(_pairs(dealt_join(members, center, "bucket", ["node"], total=total)), "minhash-tried")
    links = confirmed(tried, texts, spec)
    for further in range(ROUNDS + 1):
        group = written(components(links), "minhash-groups")
        open_ = members.join(group, "node", "left").select("bucket", "node", "weight", F.coalesce("component", "node").alias("component"))
        mixed = open_.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("bucket", "n")
        left = written(dealt_join(open_, mixed, "bucket", ["node"], total=total), "minhash-open")
        if further == ROUNDS or not left.limit(1).count():
            break
        more = _next_edges(left, tried)
        fresh = confirmed(more, texts, spec)
        tried = written(tried.union(more), "minhash-tried")
        if not fresh.limit(1).count():
            break
        links = written(links.union(fresh), "minhash-links")
    # What centers can't tell; a bucket of two members has had its one pair.
    crowded = left.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 2")
    rest = written(dealt_join(left, crowded, "bucket", ["node"], total=total).select("bucket", "node", "component"), "minhash-crowded")
    if rest.limit(1).count():
        fresh = compared(rest, texts, spec)
        if fresh.limit(1).count():
            links = written(links.union(fresh).distinct(), "minhash-links")
            group = written(components(links), "minhash-groups")
    return links, group


def _pairs(rows: DataFrame) -> DataFrame:
    """(center, node), one row for a pair in either order."""
    both = rows.where("node <> center").select(F.least("node", "center").alias("u"), F.greatest("node", "center").alias("v"), "center")
    return both.groupBy("u", "v").agg(F.min("center").alias("center")).select("center", F.when(F.col("center") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("node"))


def _next_edges(left: DataFrame, tried: DataFrame) -> DataFrame:
    """For each bucket of several components: untried edges to two more centers, as many as members at most each.

    The members outside the component of the bucket's heaviest member meet that one, and all members the heaviest one outside it.
    """
    best = F.max_by(F.struct("node", "component"), F.struct("weight", -F.col("node")))
    lead = left.groupBy("bucket").agg(best.alias("lead"), F.count("*").alias("n"))
    total = left.count()
    both = written(dealt_join(left, lead, "bucket", ["node"], total=total), "minhash-led")
    outside = both.where("component <> lead.component")
    rival = outside.groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("center"))
    rival = rival.join(both.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    to_rival = dealt_join(both.select("bucket", "node"), rival, "bucket", ["node"], total=total).select("node", "center")
    edges = _pairs(to_rival.union(outside.select("node", F.col("lead.node").alias("center"))))
    known = tried.select(F.least("node", "center").alias("u"), F.greatest("node", "center").alias("v"))
    keyed = edges.withColumns({"u": F.least("node", "center"), "v": F.greatest("node", "center")})
    return written(keyed.join(known, ["u", "v"], "left_anti").select("center", "node"), "minhash-more")


def near_duplicates(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:  # noqa: B008
    """doc_id, o, t, n_shingles, component_id, kept, stays, n_links (confirmed links of the document's set), one row a document.

    Equal sets are one node. In every bucket of several nodes the one that shares most buckets with others is the center, and the others get an edge
    to it: as many edges as members, at most. Edges are confirmed on full sets. Buckets that still hold several components get two further centers.
    In buckets that are then still of several components, every pair of nodes of different components is compared on full sets (compared), so no
    pair that shares a bucket is left out.

    component_id is the least doc_id reachable, kept says that the row has it. Rows are documents of their own: those of one doc_id with different
    texts are linked only if similar, but share a component_id. Rows without doc_id are linked like others; where no linked row has one,
    component_id is null and the row of the least text hash is kept. `stays` marks the rows that stand for a group of links: its least (o, t).
    Null, empty and blank texts are linked with nothing and all kept. doc_id must be an integer (a string of digits is read as one); columns
    beside doc_id and text are not used, whatever their names. A very long text is one block of a task.
    """
    own = signed(docs, spec)
    real = own.where("digest is not null")
    reps = real.groupBy("digest").agg(F.min(F.struct("o", "t")).alias("first"), F.first("buckets").alias("buckets"), F.count("*").alias("n"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "n", F.col("first.o").alias("o"), F.col("first.t").alias("t"), "buckets"), "minhash-reps")
    texts = Texts(docs, reps.select("node", "o", "t"), repeats(real))
    links, group = _linked(reps, texts, spec)
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = reps.select("node", "digest", "n", "o", "t").join(group, "node", "left").join(ends, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = written(nodes, "minhash-nodes")
    total = own.count()
    first = nodes.groupBy("component").agg(F.min(F.struct("o", "t")).alias("first"), F.count("*").alias("n"))
    named = written(dealt_join(nodes.withColumnRenamed("n", "times"), first, "component", ["node"], total=total).select("node", "digest", F.col("times").alias("n"), "component", "first", F.coalesce("n_links", F.lit(0)).alias("n_links")), "minhash-named")
    named = named.join(_tied(real, named), "component", "left").withColumn("least", F.coalesce("least", "first.o"))
    rows = real.select("doc_id", "o", "t", "n_shingles", "digest")
    found = dealt_join(rows, named.select("digest", "n", "first", "least", "n_links"), "digest", ["o", "t"], total=total)
    stays = F.struct("o", "t") == F.col("first")
    component = F.when(F.col("least") != NO_ID, F.col("least"))
    found = found.select("doc_id", "o", "t", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull() & stays).alias("kept"), stays.alias("stays"), "n_links")
    blank = own.where("digest is null").select("doc_id", "o", "t", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(blank)


def _tied(real: DataFrame, named: DataFrame) -> DataFrame:
    """component, least: the least o of the components that share documents of one doc_id, where any do."""
    schema = "component long, least long"
    several = real.where(F.col("o") != NO_ID).groupBy("o").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("o")
    several = written(several, "minhash-several")
    if not several.limit(1).count():
        return real.sparkSession.createDataFrame([], schema)
    both = real.join(several, "o").select("o", "digest").distinct().join(named.select("digest", "component", F.col("first.o").alias("first")), "digest").select("o", "component", "first")
    both = written(both, "minhash-shared")
    low = both.groupBy("o").agg(F.min("component").alias("u"))
    group = components(both.join(low, "o").select("u", F.col("component").alias("v")))
    lows = both.select(F.col("component").alias("node"), "first").distinct().join(group.withColumnRenamed("component", "top"), "node")
    least = lows.groupBy("top").agg(F.min("first").alias("least"))
    return written(lows.join(least, "top").select(F.col("node").alias("component"), "least").distinct(), "minhash-tied")


def one_of_each(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:  # noqa: B008
    """The documents with one row of each group of links, all columns as they were; of rows alike in doc_id and text one stays (blank ones all stay)."""
    found = written(near_duplicates(docs, spec), "minhash-result")
    gone = written(found.where("not stays").select("o", "t").distinct(), "minhash-gone")
    rows = masked(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    out = narrow_join(rows, gone, ["o", "t"], "left_anti")
    again = written(found.where("stays and n_shingles > 0").groupBy("o", "t").count().where("count > 1").select("o", "t"), "minhash-again")
    if again.limit(1).count():
        out = narrow_join(out, again, ["o", "t"], "left_anti").unionByName(narrow_join(out, again, ["o", "t"], "left_semi").dropDuplicates(["o", "t"]))
    return unmasked(out, docs.columns)


def document_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept on 2-word shingles at 0.8."""
    return near_duplicates(docs, Spec(words=2)).select("doc_id", "n_shingles", "component_id", "kept")
