"""Each operator against a brute-force version over the awkward documents, and on empty tables."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricewell.llm import decontam, linededup, media, minhash, mixing, quality, sharding, substring, suffixdedup, tokens

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()
big = lambda i: (i is None, i)


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_media(docs, rows, none):
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        m = media.wav(p)
        want[(r[0], len(b), len(p), sha(p), zlib.crc32(p[-16:]), len(m), sha(m), media.features(p))] += 1
    out = media.document_media(docs)
    assert got(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == want
    assert media.document_media(none).count() == 0


def test_media_chunks_join_up():
    data = np.random.default_rng(1).integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    whole = media.wav(media.payload_of(data))
    parts = media.chunks(whole)
    assert b"".join(parts) == whole and media.samples_of(whole).startswith(data)
    assert all(len(p) <= media.MOST for p in parts) and len(parts) > 20
    moved = media.chunks(media.wav(media.payload_of(b"inserted" + data)))
    assert len(set(parts) & set(moved)) > len(parts) - 5  # cuts follow the content


def test_stored_media_are_verified(spark, docs):
    from pyspark.sql import functions as F

    from pricewell.llm.regions import copies, firsts, identified

    own = identified(docs.where("doc_id between 50 and 60"))
    slim, marked = copies(own)
    store = media.chunk_store(firsts(own, marked)).withColumn("media_sha256", F.lit("0"))
    with pytest.raises(Exception, match="do not match"):
        media.read_back(store).collect()


def groups_by_hand(keys, sets, percent=80):
    """The least place reachable for each document, by comparing all pairs."""
    parent = list(range(len(keys)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(keys))]


def shingles_of(text, k):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_minhash(docs, rows, none):
    sets = [shingles_of(r[1], 2) for r in rows]
    group = groups_by_hand(rows, sets)
    # Rows of one doc_id share its component_id: groups that hold one doc_id have the least id of them all.
    least = {}
    for r, g, s in zip(rows, group, sets):
        if r[0] is not None and s:
            least[g] = min(least.get(g, r[0]), r[0])
    for _ in range(5):
        for i in {r[0] for r in rows if r[0] is not None}:
            own = [g for r, g, s in zip(rows, group, sets) if r[0] == i and s]
            for g in own:
                least[g] = min(least[x] for x in own)
    want = Counter()
    for r, g, s in zip(rows, group, sets):
        component = least.get(g) if s else r[0]
        if r[0] is not None:
            want[(r[0], len(s), component, r[0] == component)] += 1
        else:
            want[(None, len(s), component, component is None)] += 1
    assert got(minhash.document_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert any(k[0] is None and k[2] == 60 for k in want)  # a copy without an id
    assert minhash.document_groups(none).count() == 0


def test_texts_of_edges_go_through_one_shuffle(spark, monkeypatch):
    """Texts are dealt by the center alone, which has those of its own rows, and buckets of a node are told apart within its row."""
    plans, write = defaultdict(list), minhash.written

    def kept(df, name):
        plans[name].append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(minhash, "written", kept)
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    data = [(i, " ".join(words[:-1] + [f"w{i % 7}"])) for i in range(30)] + [(None, "a b c"), (40, None), (41, " ")]
    found = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), minhash.Spec(words=1))
    assert {r.component_id for r in found.where("doc_id < 30").collect()} == {0}
    assert plans["minhash-links"] and plans["minhash-members"]
    assert not any(re.search(r"hashpartitioning\(node#", x) for x in plans["minhash-links"] if "center" in x)
    assert not any(re.search(r"hashpartitioning\(node#\d+L?, bucket#", x) for x in plans["minhash-members"])


def test_lists_of_centers(spark):
    """Every edge once, and each center once for itself; long lists are parted, edges that come twice stay two."""
    most = minhash.GROUP_ROWS
    edges = [(c, 5000) for c in range(most + 10)] + [(7, 9), (7, 9), (8, 7)]
    found = minhash.rays(spark.createDataFrame(edges, "center long, node long").repartition(3)).collect()
    assert Counter((c, r.node) for r in found for c in r.centers) == Counter(edges) + Counter((c, c) for c in {c for c, _ in edges})
    assert max(len(r.centers) for r in found) == most and sum(r.node == 5000 for r in found) == 2
    assert not minhash.rays(spark.createDataFrame([], "center long, node long")).count()


def test_one_of_each(spark, docs, rows):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    sets = [shingles_of(r[1], 5) for r in rows]
    group = groups_by_hand(rows, sets)
    out = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(out) == len({g for g, s in zip(group, sets) if s}) + sum(not s for s in sets)
    for g in set(group):  # the least id of each group, none twice
        own = [(r[0], r[1]) for r, x, s in zip(rows, group, sets) if x == g and s]
        if own:
            assert min(own, key=lambda x: big(x[0])) in out and sum((r in own) for r in out) == 1
    lone = spark.createDataFrame([(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "x y z"), (None, None), (None, None)], "doc_id long, text string")
    assert Counter(r.text for r in minhash.one_of_each(lone).collect()) == Counter(["a b c d e f g h", "x y z", None, None])


def test_template_family(spark):
    """Pairs in a family of templates below the threshold, hidden among three crowds that share their buckets."""
    rnd = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rnd.integers(1 << 40, size=n)]
    shared = word(600)
    texts = [shared + word(72) for _ in range(2)]
    for _ in range(3):
        crowd = word(50)
        texts += [shared + crowd + word(82) for _ in range(60)]
    sets = [set(x) for x in texts]
    want = groups_by_hand(texts, sets)
    assert want[0] == want[1] == 0
    data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert got(minhash.near_duplicates(data, minhash.Spec(words=1)), "doc_id", "component_id") == Counter(enumerate(want))


@pytest.mark.parametrize("block", [200_000, 10])
def test_components(spark, block, monkeypatch):
    """A chain, stars, a ring, a pair twice in both directions, loops; in one block, and in many that rounds join."""
    from pricewell.llm import components as module
    from pricewell.llm.components import components

    monkeypatch.setattr(module, "BLOCK_LINKS", block)

    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in (3, 5, 9, 11)] + [(200, 201), (201, 202), (202, 200)] + [(50, 40), (40, 50), (60, 60)] + [(300 + (i * 7) % 31, 300 + (i * 11) % 31) for i in range(31)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = Counter((x, find(x)) for x in parent if any(x in e and e[0] != e[1] for e in links))
    assert got(components(spark.createDataFrame(links, "u long, v long")), "node", "component") == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomial_hashes_differ(spark):
    """The two words collide under every polynomial hash modulo a power of two."""
    one, two = thue_morse(1024)
    around = [f"w{i}" for i in range(19)]
    data = spark.createDataFrame([(0, one), (1, two), (2, " ".join([*around, one])), (3, " ".join([*around, two]))], "doc_id long, text string")
    assert [r.component_id for r in minhash.document_groups(data).orderBy("doc_id").collect()][:2] == [0, 1]
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert got(decontam.document_hits(data, items), "doc_id", "n_hit") == Counter({(0, 1): 1, (1, 0): 1, (2, 1): 1, (3, 0): 1})
    assert got(substring.document_windows(data), "doc_id", "n_removed") == Counter({(i, 0): 1 for i in range(4)})
    runs = spark.createDataFrame([(0, " ".join(one[:300])), (1, " ".join(two[:300])), (2, one), (3, two)], "doc_id long, text string")
    assert got(suffixdedup.document_suffixes(runs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == suffixes_by_hand(list(map(tuple, runs.collect())))


def test_word_hashes_tell_words_apart():
    from pricewell.llm import kernels as K

    one, two = thue_morse(1024)
    words = [one, two, "a", "aa", "a" * 8, "a" * 9, "a" * 16, "b" * 16, "é", "\x00", "\x00\x00", "abcdefgh", "abcdefghi", "abcdefghi\x00"] + [f"w{i}" for i in range(3000)]
    h, at = K.word_hashes([" ".join(words).encode(), b"", b" \n ", f"\t{words[0]} {words[1]}".encode()])
    assert at.tolist() == [0, len(words), len(words), len(words), len(words) + 2] and len(set(h[: len(words)].tolist())) == len(words)
    assert h[-2:].tolist() == h[:2].tolist()


def test_exact_sets():
    rnd = np.random.default_rng(8)
    texts = [" ".join(rnd.choice(list("abc"), rnd.integers(0, 40))) for _ in range(60)]
    for k in (1, 2, 3, 5, 7):
        sets = minhash.exact_sets(minhash.Spec(words=k), [t.encode() for t in texts])
        real = [shingles_of(t, k) for t in texts]
        for i in range(60):
            assert len(sets[i]) == len(real[i])
            for j in range(i):
                assert len(np.intersect1d(sets[i], sets[j])) == len(real[i] & real[j])


def test_signature_estimates_similarity():
    spec = minhash.Spec()
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    same = (minhash.signature(spec, a) == minhash.signature(spec, b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12
    one = minhash.signature(spec, a[:1])
    assert (one == a[0]).all()  # every empty bin ends at the full one


def water(sizes, weights, budget, most):
    total, open_, out = budget * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if most * sizes[i] < level * weights[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            total -= out[i]
            open_.remove(i)
    return out


def test_mixing(docs, rows, none):
    size = [len(SPACE.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = [sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources]
    goal = dict(zip(sources, water(own, [(3, 1, 2)[i % 3] for i in range(len(own))], 1.5, 2)))
    by_text = {r.doc_id: r for r in mixing.document_mix(docs).collect()}
    out = mixing.document_mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert Counter((r.doc_id, r.size) for r in mixing.document_mix(docs).collect()) == Counter((r[0], n) for r, n in zip(rows, size))
    for r in out:
        if r.doc_id != 3:  # this one has several sources
            assert r.source_size == own[sources.index(r.source)] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert by_text.keys() == {r.doc_id for r in mixing.document_mix(docs).collect()}
    assert mixing.document_mix(none).count() == 0


def taken_per_source(data):
    """(target, words taken) of each source."""
    per = {}
    for r in mixing.mix(mixing.slim(data)).collect():
        per[r.source] = (r.target, per.get(r.source, (0, 0))[1] + r["size"] * r.copies)
    return per


def test_mixing_comes_near_and_agrees(spark):
    data = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source", "repeat('w ', int(1 + id % 50)) as text")
    one, two = (sorted(map(tuple, mixing.document_mix(x).collect())) for x in (data, data.repartition(5)))
    assert one == two
    assert all(abs(goal - taken) <= 50 for goal, taken in taken_per_source(data).values())


def test_mixing_of_rows_alike(spark):
    """Rows without ids, rows of one id and repeated rows are taken to the word, not all or none."""
    data = spark.range(1500).selectExpr("case when id < 500 then id when id < 1000 then null else 7 end as doc_id", "concat('s', int(id / 500)) as source", "'three words here' as text")
    one, two = (Counter(map(tuple, mixing.document_mix(x).collect())) for x in (data, data.repartition(5)))
    assert one == two
    assert all(abs(goal - taken) <= 3 for goal, taken in taken_per_source(data).values())


def test_decontamination(docs, rows, bench, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in bench.collect():
        w = word.findall(lower(r.text))
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add("" if r.item_id is None else str(r.item_id))
    want = Counter()
    for r in rows:
        w, hit, items = word.findall(lower(r[1])), set(), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if found := windows.get(tuple(w[j : j + m])):
                    hit |= set(range(j, j + m))
                    items |= found
        want[(r[0], len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit))] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontam.document_hits(docs, bench), *columns) == want
    assert got(decontam.document_hits(docs, bench.where("false")), "n_hit") == Counter({(0,): len(rows)})
    assert decontam.document_hits(none, bench).count() == 0
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert got(clean, "doc_id", "text", "hits") == Counter((r[0], r[1], "h") for r in rows if not any((r[0], *x) in want for x in [k[1:] for k in want if k[0] == r[0] and k[5]]))


def test_decontamination_passes_and_places(docs, bench, monkeypatch):
    one = got(decontam.document_hits(docs, bench), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontam, "PASS_BYTES", 120)
    assert got(decontam.document_hits(docs, bench), "doc_id", "n_hit", "items_sha256") == one
    texts = [b"a b c d e f g h i j k l m", b"z a b c d e f g h i j k q"]
    index = decontam.index_of([("7", b"x a b c d e f g h i j k y", 0)], 10)
    found = decontam.search(texts, index, 10)
    doc, item, item_word, doc_word, length = decontam.extended(found, index, np.arange(len(found.text)))
    assert found.n_words.tolist() == [13, 13]
    assert sorted(map(tuple, found.spans.tolist())) == [(0, 0, 10), (0, 1, 11), (1, 1, 11), (1, 2, 12)]
    assert set(zip(doc.tolist(), item_word.tolist(), doc_word.tolist(), length.tolist())) == {(0, 1, 0, 11), (1, 1, 1, 11)}


def test_items_that_share_a_prompt_are_taken_in_slices(monkeypatch):
    """20,000 items and 300 texts with one prompt of 14 words: 30 million places times items, of which a task holds a slice at a time."""
    prompt = " ".join(f"p{i}" for i in range(14))
    items = [(str(i), f"{prompt} own{i} a{i} b{i}".encode(), 0) for i in range(20_000)]
    index = decontam.index_of(items, 10)
    texts = [f"before {k} {prompt} own{k} a{k} other".encode() for k in range(300)]
    tracemalloc.start()
    found, n = decontam.search(texts, index, 10), 0
    for a, b, part in decontam._portions(found, index, len(texts)):
        d, item, _, doc_word, length = decontam.extended(found, index, part)
        assert a == n and (np.bincount(d - a, minlength=b - a) == 20_000).all() and set(doc_word.tolist()) == {2}
        n = b
        for k in range(a, b):
            assert sorted(set(length[d == k].tolist())) == [14, 16] and item[(d == k) & (length == 16)].tolist() == [k]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 and peak < 200e6
    # Slices of any size give the same.
    monkeypatch.setattr(decontam, "MOST_ROWS", 1000)
    few = decontam.search(texts[:2], index, 10)
    assert all((np.bincount(decontam.extended(few, index, part)[0] - a, minlength=b - a) == 20_000).all() for a, b, part in decontam._portions(few, index, 2))


def test_passes_keep_every_column_and_repeated_rows(spark, monkeypatch):
    rows = [(1, "a b c d e f g h i j k", "x"), (1, "a b c d e f g h i j k", "x"), (None, "q r s t u v w x y z zz", "y"), (2, None, "z"), (3, "nothing of it", None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(("a b c d e f g h i j", "b c d e f g h i j k", "q r s t u v w x y z"))], "item_id long, text string")
    monkeypatch.setattr(decontam, "PASS_BYTES", 20)
    found = decontam.document_hits(data, bench)
    assert got(found, "doc_id", "n_words", "n_hit", "n_items") == Counter({(1, 11, 11, 2): 2, (None, 11, 10, 1): 1, (2, 0, 0, 0): 1, (3, 3, 0, 0): 1})
    clean = decontam.clean(data, bench)
    assert clean.columns == data.columns and got(clean, "doc_id", "_row") == Counter({(2, "z"): 1, (3, None): 1})


def test_substring(docs, rows, none):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    null = [k for k in order if rows[k][0] is None]
    seen, want, done = {}, Counter(), {}
    ordered = [k for k in order if rows[k][0] is not None]
    for k in ordered:
        i, x = rows[k][0], rows[k][1] or ""
        if (i, x) not in done:  # repeated rows are one document
            w = SPACE.findall(x)
            gone = np.zeros(len(w), bool)
            for j in range(len(w) - 19):
                if tuple(w[j : j + 20]) in seen:
                    gone[j : j + 20] = True
                seen[tuple(w[j : j + 20])] = 1
            done[i, x] = (i, len(w), int(gone.sum()), sha(" ".join(a for a, g in zip(w, gone) if not g).encode()))
        want[done[i, x]] += 1
    out = got(substring.document_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter({k: n for k, n in out.items() if k[0] is not None}) == want
    assert sum(n for k, n in out.items() if k[0] is None) == len(null)
    assert any(k[0] is None and k[2] == 300 for k in out)  # the copy without an id comes last
    assert substring.document_windows(none).count() == 0


def test_sketch_may_be_narrow_or_stay_a_table(docs, monkeypatch):
    """A narrow sketch passes more on; one too wide to broadcast marks the samples in its slices, also where their keys are dealt. Results are the same."""
    from pricewell.llm import common, regions

    own = lambda: (got(substring.document_windows(docs), "doc_id", "n_removed", "kept_sha256"), got(suffixdedup.document_suffixes(docs), "doc_id", "n_removed", "n_spans", "kept_sha256"))
    want = own()
    monkeypatch.setattr(regions, "LEAST_BITS", 16)
    assert own() == want
    monkeypatch.setattr(regions, "MOST_BITS", 12)
    assert own() == want
    monkeypatch.setattr(common, "GROUP_ROWS", 5)
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    assert own() == want


def test_marks_are_those_of_the_broadcast_sketch(spark, docs):
    from pricewell.llm import regions

    rows = regions.identified(docs).dropDuplicates(["o", "t"])
    spec = substring.SPEC
    bits = 16
    slices = regions.sketch(rows, spec, bits)
    table = np.frombuffer(regions._whole(slices, bits), np.uint8)
    marks = {(r.o, r.t): set(r.marks) for r in regions.marked_samples(rows, spec, slices, bits).collect()}
    some = 0
    for r in rows.collect():
        own = next(regions.units_of(spec, [(r.text or "").encode()]))
        sample = np.unique(regions.samples_of(spec, own))
        want = set(sample[regions.maybe_repeated(sample, bits, table)].view(np.int64).tolist()) if len(sample) else set()
        assert marks.get((r.o, r.t), set()) == want
        some += len(want)
    assert some > 100


def suffixes_by_hand(rows):
    count, texts = Counter(), [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in texts:
        count.update(b[j : j + 200] for j in range(len(b) - 199))
    want = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    return want


def test_suffixes(docs, rows, none):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(suffixdedup.document_suffixes(docs), *columns) == suffixes_by_hand(rows)
    assert suffixdedup.document_suffixes(none).count() == 0


def test_large_buckets_are_split(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixdedup, "MOST_REGIONS", 1)
    assert got(suffixdedup.document_suffixes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == suffixes_by_hand(rows)


def test_blocks_sort_suffixes():
    rng = np.random.default_rng(2)
    parts = [rng.integers(97, 99, 40, dtype=np.uint8).tobytes() for _ in range(4)]
    regions = [b"".join(parts[i] for i in rng.integers(0, 4, 8)) for _ in range(30)] + [b"abcd" * 100, b"x" * 300]
    block = suffixdedup.Block(regions, 200, [int(x) for x in rng.integers(0, 200, len(regions))])
    head, rank = block.ranks()
    order = np.lexsort([rank, head])
    strings = [regions[r][o : o + 200] for r, o in zip(block.region.tolist(), block.offset.tolist())]
    assert [block.text[p : p + 200].tobytes() for p in block.suffix.tolist()] == strings
    in_order = [strings[k] for k in order]
    assert in_order == sorted(in_order)
    repeated = Counter(strings)
    assert [bool(x) for x in block.repeated()] == [repeated[s] > 1 for s in strings]


def shards_by_hand(rows, shards=16):
    """(doc_id, size, shard, slot): rows in order, each in the shard in whose equal share of all bytes its middle lies."""
    from fractions import Fraction

    own = sorted(((r[0] is not None, r[0] or 0), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1, r[0]) for r in rows)
    total, at, slots, out = sum(r[2] for r in own), 0, Counter(), Counter()
    for _, crc, size, doc_id in own:
        shard = min(shards - 1, int(Fraction(2 * at + size, 2) * shards / total))
        out[(doc_id, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        at += size
    return out


def test_shards(docs, rows, none):
    out = sharding.document_shards(docs)
    assert got(out, "doc_id", "size", "text_crc32", "shard", "slot") == shards_by_hand(rows)
    assert {(r.law, r.grown_shard) for r in out.collect()} == {("bytes", None)}
    assert sharding.document_shards(none).count() == 0
    placed = sharding.place(docs)
    assert placed.columns == [*(c for c in docs.columns if c != "shard"), "shard", "slot"]
    own = sorted((r.shard, r.slot) for r in placed.collect())
    assert Counter(own) == Counter((k[3], k[4]) for k in shards_by_hand(rows).elements())


def test_shards_of_rows_alike(spark):
    """A third of all rows without id and text are spread over the partitions."""
    rows = [(i, "x" * (i % 50)) for i in range(2000)] + [(None, None)] * 1000
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(sharding.document_shards(data), "doc_id", "size", "text_crc32", "shard", "slot") == shards_by_hand(rows)
    slim = data.select("doc_id", (sharding.F.length(sharding.F.coalesce("text", sharding.F.lit(""))) + 1).alias("size"))
    parts = slim.withColumn("_tie", sharding.F.xxhash64(sharding.F.monotonically_increasing_id())).repartitionByRange(8, "doc_id", "_tie")
    assert max(r["count"] for r in parts.groupBy(sharding.F.spark_partition_id()).count().collect()) < 900


def test_shards_around_a_very_long_text(spark):
    """A text that holds most bytes fills several equal shares: the shards within it stay empty, and slots have no gaps."""
    rows = [(i, "a b") for i in range(400)] + [(200, "long " * 2_000_000)]
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.document_shards(data)
    assert got(out, "doc_id", "size", "text_crc32", "shard", "slot") == shards_by_hand(rows)
    assert len({r.shard for r in out.collect()}) < 16


def test_shards_are_even(spark):
    data = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', int(id % 97)) as text")
    sums = [r[0] for r in sharding.document_shards(data).groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 2 * 98


def test_tokens(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary())
    want = Counter()
    for r in rows:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 2048)] += 1
    assert got(tokens.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokens.count_tokens(none).count() == 0


def test_quality(spark, docs, rows, none):
    base = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    shown = quality.document_quality(real, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id").withColumnRenamed("toxic", "posterior")
    hidden = quality.score(real, labels.where("doc_id % 4 <> 0")).select("doc_id", "kept").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    bad = [r for r in hidden if r.quality == 0 or r.toxic == 1]
    good = [r for r in hidden if r.quality == 1 and r.toxic == 0]
    assert shown.columns and sum(not r.kept for r in bad) / len(bad) > 0.8
    assert sum(r.kept for r in good) / len(good) > 0.98
    nothing = labels.where("false")
    assert quality.accepted(docs, nothing).count() == len(rows)
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.document_quality(none, labels).count() == 0
    odd = spark.createDataFrame([(None, 0, 1), (1, None, None), (5, 0, 0), (5, 0, 0), (6, 1, 0)], labels.schema)
    assert quality.document_quality(docs, odd).count() == len(rows)


def quality_by_hand(docs, labels, deviation):
    """The posteriors by loops over dictionaries; docs are (doc_id, text, lang, source) without near copies."""
    import math

    known = {i: (int(q == 0), int(t)) for i, q, t in labels}
    cells = {d[0]: next(quality.cells([(d[1] or "").encode()])) for d in docs}
    strata = {d[0]: quality.stratum(d[2], cells[d[0]][1]) for d in docs}
    rates, ratios = [], [{}, {}]
    for k in (0, 1):
        p = sum(known[i][k] for i in known) / len(known)
        rates.append(min(0.99, max(0.01, p)))
        by = {s: (sum(known[i][k] for i in known if strata[i] == s) + 20 * p) / (sum(strata[i] == s for i in known) + 20) for s in {strata[i] for i in known}}
        for c in {int(c) for i in known for c in cells[i][0]}:
            own = [i for i in known if c in cells[i][0]]
            n, y, e = len(own), sum(known[i][k] for i in own), sum(by[strata[i]] for i in own)
            if n >= 5 and abs(y - e) > deviation * math.sqrt(sum(by[strata[i]] * (1 - by[strata[i]]) for i in own)):
                ratio = math.log((y + 0.5) / (e + 0.5)) - math.log((n - y + 0.5) / (n - e + 0.5))
                ratios[k] |= {c: ratio} if abs(ratio) >= 1 else {}
    llr = {d[0]: [sum(r.get(int(c), 0.0) for c in cells[d[0]][0]) for r in ratios] for d in docs}
    logit, sigmoid = (lambda p: math.log(p / (1 - p))), (lambda x: 1 / (1 + math.exp(-x)))
    soft = {i: [sigmoid(x[k] + logit(rates[k])) for k in (0, 1)] for i, x in llr.items()}
    out = {}
    for i, _, lang, source in docs:
        own = []
        for k in (0, 1):
            mean = lambda some, up: (sum(soft[j][k] for j in some) + 50 * up) / (len(some) + 50)  # noqa: B023, E731
            top = sum(soft[j][k] for j in soft) / len(soft)
            site = mean([d[0] for d in docs if d[3] == source], top)
            path = mean([d[0] for d in docs if (d[3], d[2]) == (source, lang)], site)
            own.append(sigmoid(llr[i][k] + logit(min(1 - 1e-6, max(1e-6, path)))))
        out[i] = tuple(own)
    return out, ratios


def test_quality_by_hand(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(160):
        own = [rnd.choice(words) for _ in range(rnd.randint(12, 120))]
        low, toxic = i % 4 == 0, i % 5 == 0
        text = " ".join(f"{w}###" if low else w for w in own) + (" nasty nasty" if toxic else "")
        docs.append((i, text if i % 31 else None, [None, "en", "de"][i % 3], ["a", "b", None][i % 7 % 3]))
        if i % 8 != 7 and i % 31:
            labels.append((i, int(not low), int(toxic)))
    monkeypatch.setattr(quality, "DEVIATION", 2.0)
    want, ratios = quality_by_hand(docs, labels, 2.0)
    assert all(len(r) > 2 for r in ratios)
    data = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for r in quality.score(data, known).collect():
        assert (r.low, r.toxic) == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.kept == (want[r.doc_id][0] < 0.9 and want[r.doc_id][1] < 0.99)
    named = data.selectExpr("doc_id", "text", "lang", "source", "1 as t", "2 as low", "3 as kept", "4 as c0")
    assert quality.accepted(named, known).columns == named.columns


def test_priors_shrink_to_the_whole(spark):
    rows = [("a", "en", 4.0)] * 200 + [("b", "en", -4.0)] * 200 + [("c", "en", 4.0)] * 2 + [(None, None, -4.0)]
    data = spark.createDataFrame([(s, x, v, v) for s, x, v in rows], "source string, lang string, low_llr double, toxic_llr double")
    prior = {r.source: r.low_prior for r in quality.posteriors(data, (0.5, 0.5)).select("source", "low_prior").distinct().collect()}
    assert prior["a"] > 0.85 and prior["b"] < 0.15 and 0.4 < prior["c"] < 0.6 and 0.4 < prior[None] < 0.6


def test_lines(spark):
    page = lambda i, url, html: (i, url, html)
    rows = [page(i, f"https://A.example.com/{i}", f"<nav>Home | About</nav><p>story {i}</p><div>same</div><br>&amp;") for i in range(10)]
    rows += [page(20, "http://b.example.com", "<p>Home | About</p>"), page(21, None, None), page(22, "no url", ""), page(23, "https://A.example.com:8080/x", "<script>var a='<p>no</p>'</script><p>alone</p><p>same</p>")]
    data = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in linededup.drop_boilerplate(data).collect()}
    assert out[1].kept == ["story 1"] and (out[1].n_lines, out[1].n_dropped, out[1].host) == (4, 3, "a.example.com")
    assert out[20].kept == ["Home | About"] and out[21].kept == [] and out[22].kept == []
    assert out[23].kept == ["alone"] and out[23].host == "a.example.com"
    assert linededup.page_lines(data.where("false")).count() == 0


def test_lines_of_malformed_pages(spark):
    """What is left open searches the rest of a page once: pages of 5 MB end in seconds, and as the patterns alone would have them."""
    big = 5_000_000
    rows = [(1, "<!-- " * (big // 5)), (2, "<script>x" * (big // 9)), (3, "<" * big), (4, "<p " * (big // 3)), (5, "<p>a" + "<x <b " * (big // 6) + "<p>"), (6, "a>" * (big // 2))]
    small = ["<!-->x<p>y", "a<!-- b --> c <!-- d", "<script>1</style>2<script>3", "<!-- <script> --> a </script> b", "a < b <p> c > d <", "<p", "x<!-- <p> y", "<SCRIPT>a</script >b</ScRiPt>c", "1 &lt;p&gt; <b>&amp;nbsp;", "<style>\n</style\n><p>x</p>"]
    data = spark.createDataFrame([(i, "http://h", x) for i, x in rows] + [(10 + k, "http://h", x) for k, x in enumerate(small)], "page_id long, url string, html string")
    began = time.time()
    out = {r.page_id: r.lines for r in linededup.with_lines(data).select("page_id", "lines").collect()}
    assert time.time() - began < 60
    assert out[1] == ["<!-- " * (big // 5 - 1) + "<!--"] and out[3] == ["<" * big] and out[6] == ["a>" * (big // 2)]

    def plainly(text):
        for pattern, to in linededup.MARKUP:
            text = re.sub(pattern, to, text)
        lines = [re.sub("[ \t]+", " ", x).strip(" ") for x in re.split("[\n\r]+", text)]
        return [x for x in lines if x]

    assert [out[10 + k] for k in range(len(small))] == [plainly(x) for x in small]


def lines_by_hand(rows, ratio=0.3, least=2):
    """(page_id, host, lines, dropped, digest) of rows (page_id, host, lines)."""
    pages, on = Counter(h for _, h, _ in rows), Counter((h, x) for _, h, lines in rows for x in set(lines))
    out = Counter()
    for i, h, lines in rows:
        kept = [x for x in lines if not (on[h, x] >= least and on[h, x] > ratio * pages[h])]
        out[(i, h, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))] += 1
    return out


def test_lines_of_hot_hosts(spark, monkeypatch):
    """Repeated rows, a very long page, one host of most pages, clashing names; hot hosts are dealt to several tasks."""
    from pricewell.llm import common

    rnd = random.Random(2)
    rows = [(i, "hot.example" if i % 3 else f"h{i % 40}.example", [f"line {rnd.randrange(40)}" for _ in range(rnd.randrange(12))]) for i in range(900)]
    rows += [rows[5]] * 3 + [(None, "hot.example", ["line 1"]), (950, "lone.example", ["only", "only"]), (951, "two.example", ["same", "a"]), (952, "two.example", ["same", "b"]), (953, "hot.example", [f"long {k}" for k in range(20_000)])]
    data = spark.createDataFrame([(i, f"http://{h}/x", "".join(f"<p>{x}</p>" for x in lines), h, 1) for i, h, lines in rows], "page_id long, url string, html string, host string, n int")
    columns = ("page_id", "host", "n_lines", "n_dropped", "kept_sha256")
    assert got(linededup.page_lines(data), *columns) == lines_by_hand(rows)
    monkeypatch.setattr(common, "GROUP_ROWS", 20)
    assert got(linededup.page_lines(data), *columns) == lines_by_hand(rows)


def test_dealt_join_loses_nothing(spark, monkeypatch):
    from pricewell.llm import common

    left = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 100) as k", "id as place")
    right = left.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as v").where("k <> 7")
    for most in (10, 100_000):
        monkeypatch.setattr(common, "GROUP_ROWS", most)
        for how, n in (("inner", 3000 - left.where("k = 7").count()), ("left", 3000)):
            out = common.dealt_join(left, right, "k", ["place"], how)
            assert out.count() == n and out.columns == ["k", "place", "v"] and out.where("v <> 2 * k").count() == 0


def test_results_are_the_same_when_keys_are_dealt(docs, monkeypatch):
    from pricewell.llm import common

    queries = (lambda: media.document_media(docs), lambda: minhash.document_groups(docs), lambda: suffixdedup.document_suffixes(docs), lambda: substring.document_windows(docs))
    want = [Counter(map(tuple, q().collect())) for q in queries]
    monkeypatch.setattr(common, "GROUP_ROWS", 1)
    assert [Counter(map(tuple, q().collect())) for q in queries] == want


def test_tokens_are_remembered_by_the_worker(spark):
    """Tasks of one worker process share the lengths of rare pre-tokens."""
    path = tokens.vocabulary()
    data = spark.createDataFrame([(i, f"unheardofword{i % 3}") for i in range(40)], "doc_id long, text string").repartition(20)
    assert tokens.count_tokens(data).count() == 40

    def met(batches):
        import pyarrow as pa

        from pricewell.llm import tokens as own

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(own.remembered(path))]})

    assert max(r.n for r in spark.range(0, 80, 1, 8).mapInArrow(met, "n long").collect()) >= 3


def test_family_just_below_the_threshold(spark, monkeypatch):
    """Members that share a bucket but not a center: pairs of siblings at 0.81 in a family at 0.79."""
    rnd = np.random.default_rng(11)
    word = lambda: f"w{rnd.integers(1 << 40)}"
    base = [word() for _ in range(400)]
    texts = []
    for _ in range(60):
        own = [*base, *(word() for _ in range(53))]
        texts += [own, [*own[:406], *(word() for _ in range(47))]]
    data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    spec = minhash.Spec(words=1)
    sets = [set(x) for x in texts]
    assert 0.78 < len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8 < len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    want = Counter((i, i - i % 2) for i in range(120))
    assert got(minhash.near_duplicates(data, spec), "doc_id", "component_id") == want
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 5_000)
    assert got(minhash.near_duplicates(data, spec), "doc_id", "component_id") == want


def test_long_clean_documents_are_kept(spark):
    base = "/root/testdata/sf0.1"
    real, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    clean = [r.text for r in real.where("lang = 'en'").join(labels.where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").select("text").collect()]
    words = " ".join(clean).split()
    long = [(-n, " ".join((words * (n // len(words) + 1))[:n]), "en", "s") for n in (1_000, 20_000, 50_000, 100_000, 400_000)]
    data = spark.createDataFrame(long, "doc_id long, text string, lang string, source string")
    ratios, rates = quality.learn(real, labels)
    seen = {r.doc_id: (r.low, r.low_llr) for r in quality.posteriors(quality.evidence(real.select(*data.columns).unionByName(data), ratios), rates).where("doc_id < 0").collect()}
    assert all(low < quality.REJECT["low"] for low, _ in seen.values()), seen
    assert max(x for _, x in seen.values()) - min(x for _, x in seen.values()) < 0.5, seen
