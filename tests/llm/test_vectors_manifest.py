"""op11 to op13 against brute force on small and awkward tables."""

import hashlib
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewell.llm import embedding, hardneg, merkle
from pricewell.llm.embedding import Spec

# --- op11


def _near(vectors):
    """Links and components by all pairs; vectors: (vec_id, list or None)."""

    def unit(x):
        if not x or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            return None
        x = np.array(x, np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(x) for _, x in vectors]
    parent = list(range(len(vectors)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(vectors)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, (v, _) in enumerate(vectors):
        least[top(i)].append(v)
    name = {k: min((v for v in x if v is not None), default=None) for k, x in least.items()}
    return [(v, links[i], name[top(i)]) for i, (v, _) in enumerate(vectors)]


def _clustered(rnd, n, dim, spread, first):
    center = rnd.standard_normal(dim)
    return [(first + i, (center + spread * rnd.standard_normal(dim) * np.linalg.norm(center) / np.sqrt(dim)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(5)
    out = [(i, rnd.standard_normal(16).tolist()) for i in range(120)]
    out += _clustered(rnd, 150, 16, 0.08, 1000)  # one large group of near copies
    for k in range(12):
        out += _clustered(rnd, 5, 16, 0.05, 2000 + 10 * k)
    same = rnd.standard_normal(16).tolist()
    out += [(3000 + i, same) for i in range(90)] + [(3100, [2 * x for x in same])]
    out += [(None, same), (None, rnd.standard_normal(16).tolist()), (5, same)]  # no id; an id twice with other vectors
    out += [(4000, None), (4001, [0.0] * 16), (4002, []), (4003, [None, *[1.0] * 15]), (4004, [float("nan")] * 16), (4005, [float("inf")] * 16)]
    out += [(4010, [1.0, 2.0, 3.0]), (4011, [2.0, 4.0, 6.0]), (4012, [-0.0, 1e300, 1e-300]), (4013, [0.0, 3e-310, 0.0]), (4014, [0.0, 1.0, 0.0])]
    return out


SCHEMA = "vec_id long, embedding array<double>, node long, n int, vector string, bucket string, row string, component string"


@pytest.mark.parametrize(("spec", "block"), [(Spec(), 128), (Spec(hot=20), 24), (Spec(hot=20, spread=0), 24), (Spec(hot=3), 2)])
def test_near_vectors_against_all_pairs(spark, vectors, spec, block, monkeypatch):
    """Without families, with some, and with crowded buckets that are none; large ones in blocks."""
    monkeypatch.setattr(embedding, "LEAST_BLOCK", block)
    monkeypatch.setattr(embedding, "MOST_BLOCK", block)
    rows = spark.createDataFrame([(v, x, 1, 1, "v", "b", "r", "c") for v, x in vectors], SCHEMA).repartition(3)
    found = embedding.near_vectors(rows, spec).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=key) == sorted(_near(vectors), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.component_id is not None)
    assert sum(r.kept for r in found if r.component_id is None) == 1


def test_near_vectors_of_an_empty_table(spark):
    assert embedding.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_just_at_the_threshold():
    """Pairs of a cosine of 0.95 share a bucket but for about `miss` of them, at any number of bits."""
    rnd = np.random.default_rng(1)
    a = rnd.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rnd.standard_normal((3000, 32))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    for n in (500, 50_000):
        spec = Spec().fitted(n)
        met = (embedding.keys(spec, a) == embedding.keys(spec, b)).any(axis=1)
        assert met.mean() > 0.995


def test_pairs_of_a_unit_are_found_once():
    """Over the units of all tables, each linked pair comes once, and the forest joins all that is linked."""
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal(16) + 0.15 * rnd.standard_normal((60, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spec = Spec(bits=8)
    sign = embedding.keys(spec, x)
    seen = defaultdict(int)
    for tab in range(spec.tables):
        for bucket in np.unique(sign[:, tab]):
            own = np.flatnonzero(sign[:, tab] == bucket)
            one = np.ones(len(own), np.int64)
            for i, j in embedding._linked(spec, x[own], one, one * tab, one, -one):
                for p, q in zip(own[i], own[j], strict=True):
                    seen[min(p, q), max(p, q)] += 1
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= spec.cosine}
    assert set(seen.values()) == {1} and set(seen) <= want and len(seen) >= 0.99 * len(want)
    forest = embedding._Forest(60)
    i, j = np.array(sorted(seen)).T
    assert len(forest.joins(i, j)) == 60 - len(np.unique(forest.label))


# --- op12


def _mined(rows):
    """Every score of every anchor; rows: (vec_id, label, integers, anchor), of one dimension."""
    order = lambda v: (v is None, v or 0)
    own = [(i, v, lab, x, anchor) for i, (v, lab, x, anchor) in enumerate(rows) if lab is not None and x and all(c is not None and abs(c) <= hardneg.LIMIT for c in x)]
    out = []
    for i, v, lab, x, anchor in own:
        if not anchor:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), order(w), w, other) for j, w, other, y, _ in own if j != i and len(x) == len(y)), key=lambda t: t[:2])
        for s, _, w, _ in [t for t in scored if t[3] == lab][:5]:
            inside = [t for t in scored if t[3] != lab and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(v, w, k + 1, t[2], -s, -t[0]) for k, t in enumerate(inside)]
    return sorted(out, key=str)


HARD = "vec_id long, label int, x array<long>, anchor boolean, kind string, score string, row string, vec string"


@pytest.mark.parametrize(("n", "dim", "size", "anchors", "passes"), [(400, 8, 256, 12, 1), (150, 3, 4, 20, 1), (300, 16, 60_000, 9, 3), (4, 5, 100, 2, 1)])
def test_hard_negatives_against_all_scores(spark, monkeypatch, n, dim, size, anchors, passes):
    rnd = random.Random(n)
    rows = [(i, rnd.randrange(3), [rnd.randint(-size, size) for _ in range(dim)], i < anchors) for i in range(n)]
    monkeypatch.setattr(hardneg, "PASS_BYTES", -(-anchors * (8 * dim + 72) // passes))
    found = hardneg.hard_negatives(spark.createDataFrame([(*r, "k", "s", "r", "v") for r in rows], HARD).repartition(3)).collect()
    assert sorted(map(tuple, found), key=str) == _mined(rows)


@pytest.mark.parametrize(("size", "dim"), [(1, 3), (200, 64), (1 << 20, 16), (1 << 26, 40), (1 << 26, 1500)])
def test_slices_of_planes_against_products(size, dim):
    """Every pair between its anchor's bounds, and no score but the exact one: sums of 32-bit and 64-bit floats and of integers, few pairs open and many."""
    rnd = np.random.default_rng(size)
    anchors, rows = rnd.integers(-size, size + 1, (9, dim)), rnd.integers(-size, size + 1, (300, dim))
    rows[:9], rows[9] = anchors, np.sign(anchors[0]) * size  # scores as great as they can be
    whole = anchors @ rows.T
    ends = np.sort(whole, axis=1)
    no = np.iinfo(np.int64)
    for low, high in ((ends[:, -5], np.full(9, no.max)), (ends[:, 100], ends[:, 220]), (np.full(9, no.min), ends[:, 3]), (np.full(9, no.min), np.full(9, no.max)), (np.full(9, no.max), np.full(9, no.min))):
        for share in (1.0, 0.3, 0.01):
            may = rnd.random(whole.shape) < share
            who, what, score = hardneg.sliced(anchors, rows, may.copy(), low, high)
            assert (score == whole[who, what]).all() and may[who, what].all()
            found = np.zeros(whole.shape, bool)
            found[who, what] = True
            assert (found >= (may & (whole >= low[:, None]) & (whole <= high[:, None]))).all()


def test_rows_are_sorted_only_where_they_may_enter(monkeypatch):
    """What a task has found drops most pairs of its later blocks before they are sorted or searched for a k-th score."""
    rnd = np.random.default_rng(3)
    x, label = rnd.integers(-150, 150, (12_000, 32)), rnd.integers(0, 10, 12_000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(12_000)), pa.array(np.arange(12_000)), pa.array(label), pa.array([v.tobytes() for v in x], pa.binary())], names=["row", "vec", "label", "x"])
    scores = np.sort(np.where((label[:60, None] == label) & (np.arange(60)[:, None] != np.arange(12_000)), x[:60] @ x.T, no_score := -(1 << 40)), axis=1)[:, :-6:-1]
    assert (scores > no_score).all()
    anchors = hardneg._Anchors({32: x[:60]}, {32: label[:60]}, {32: np.arange(60)}, {32: scores})
    sorted_, parted, tasks = [], [], []
    lexsort, partition = np.lexsort, np.partition
    monkeypatch.setattr(hardneg.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    monkeypatch.setattr(hardneg.np, "partition", lambda v, *a, **b: parted.append(v.size) or partition(v, *a, **b))
    rows = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))), mapInArrow=lambda run, _: tasks.append(run))
    hardneg._positives(rows, anchors, hardneg.Spec())
    hardneg._negatives(rows, anchors, hardneg.Spec())
    found = [pa.Table.from_batches(run(iter([batch]))).num_rows for run in tasks]
    assert found[0] == 60 * 5 and found[1] <= 60 * 5 * 10
    pairs = 60 * 12_000
    assert sum(sorted_) < pairs / 4 and sum(parted) < 2 * pairs, (sum(sorted_), sum(parted), pairs)


def test_hard_negatives_of_awkward_rows(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(2), [rnd.randint(0, 30) for _ in range(4)], i % 5 == 0) for i in range(60)]
    rows += [(100, None, [1, 2, 3, 4], True), (101, 1, None, True), (102, 1, [1, None, 3, 4], True), (103, 1, [], True), (104, 0, [1 << 40, 1, 1, 1], True), (105, 0, [-(1 << 63), 1, 1, 1], False)]
    rows += [(106, 0, [5, 6], True), (107, 0, [7, 8], None), (108, 1, [6, 6], False), (None, 1, [9, 9, 9, 9], None), (110, 5, [1, 1, 1, 1], True)]
    found = hardneg.hard_negatives(spark.createDataFrame([(*r, "k", "s", "r", "v") for r in rows], HARD).repartition(2)).collect()
    assert sorted(map(tuple, found), key=str) == _mined(rows)
    assert hardneg.hard_negatives(spark.createDataFrame([], HARD)).count() == 0
    # Equal rows: as many, whichever of them comes first.
    copies = [(i % 4, 0 if i < 20 else 1, [3, 4], i == 0) for i in range(40)]
    found = hardneg.hard_negatives(spark.createDataFrame([(*r, "k", "s", "r", "v") for r in copies], HARD)).collect()
    assert len(found) == 0  # every negative scores as much as its positive, above the upper bound


def test_labels_and_components_of_the_query(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(10), [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(0, 700, 3)]
    rows += [(2100, 3, None), (2200, 3, [float("nan")] * 6), (2300, 3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2400, None, [0.5] * 6), (-7, -1, [0.5] * 6), (None, 2, [0.25] * 6)]
    found = hardneg.embedding_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    moved = lambda v, lab: lab if v is None or v % 7 else int(np.fmod(lab + 1, 10))
    f32 = lambda x: float(np.float32(x))
    whole = [(v, moved(v, lab), [int(np.floor(256 * f32(c))) for c in x], v is not None and v % 100 == 0) for v, lab, x in rows if lab is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    assert sorted(map(tuple, found), key=str) == _mined(whole)


# --- op13


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _reduced(nodes):
    """The root and each node's siblings (before, after), level by level."""
    ways, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in owners[a + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(_h(*run))
            over.append([i for o in owners[a : a + 8] for i in o])
        nodes, owners = up, over
    return nodes[0], ways


def _manifest(rows):
    """rows: (doc_id, lang, leaf, other)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    parts = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        parts[g] = (own, *_reduced([r[2] for r in own]))
    root, ups = _reduced([parts[g][1] for g in names])
    out = []
    for g, up in zip(names, ups, strict=True):
        own, sub, ways = parts[g]
        for r, way in zip(own, ways, strict=True):
            node = r[3]
            for before, after in way + up:
                node = _h(before, node, after)
            out.append((r[0], r[2], sub, root, _h(*(x for step in way + up for x in step)), node, node == root))
    return sorted(out, key=str)


def _document_leaves(rows):
    def leaf(i, source, lang, n_chars, text):
        return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n_chars, text)))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for i, text, lang, source, n_chars, *_ in rows:
        touched = i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0
        one = leaf(i, source, lang, n_chars, text)
        out.append((i, lang, one, leaf(i, source, lang, n_chars, text.translate(lower)) if touched else one))
    return out


def test_manifest_of_awkward_documents(spark, docs, rows, none):
    found = merkle.document_manifest(docs).collect()
    assert sorted(map(tuple, found), key=str) == _manifest(_document_leaves(rows))
    assert {r.verified for r in found} == {True, False}
    assert merkle.document_manifest(none).count() == 0


@pytest.mark.parametrize(("sizes", "top"), [({"a": 1}, 4096), ({"a": 8, "b": 9, None: 1}, 4096), ({"a": 700, "b": 520, "c": 512, "d": 513, "": 64, None: 65}, 2), ({f"g{i}": 1 + (i == 5) * 600 for i in range(560)}, 3)])
def test_manifest_of_groups_of_any_size(spark, monkeypatch, sizes, top):
    """Groups at the edges of blocks; with few nodes for the driver, trees of several rounds of blocks; more groups than it may hold."""
    monkeypatch.setattr(merkle, "TOP_NODES", top)
    rows, n = [], 0
    for g, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 9973, g, _h(str(n)), _h(str(n)) if n % 3 else _h("x", str(n))))
    slim = spark.createDataFrame(rows, "doc_id long, grp string, leaf string, other string").withColumns({c: F.unhex(c) for c in ("leaf", "other")}).repartition(3)
    found = merkle.manifest(slim, steps=True).collect()
    assert sorted((tuple(r)[:7] for r in found), key=str) == _manifest(rows)
    r = found[0]
    assert merkle.folded(r.leaf, list(zip(r.befores, r.afters, strict=True))) == r.root


def test_manifest_of_repeated_rows(spark):
    """A third of the rows alike: they are spread over the partitions."""
    rows = [(7, "a", _h("same"), _h("same"))] * 800 + [(i, "a", _h(str(i)), _h(str(i))) for i in range(1600)]
    slim = spark.createDataFrame(rows, "doc_id long, grp string, leaf string, other string").withColumns({c: F.unhex(c) for c in ("leaf", "other")})
    found = merkle.manifest(slim, parts=6).collect()
    assert sorted(map(tuple, found), key=str) == _manifest(rows) and all(r.verified for r in found)
