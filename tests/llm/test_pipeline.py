"""The pipeline's stages, each against a brute-force version of its own input."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from pricewell.llm import quality
from pricewell.llm.common import written

from .test_operators import SPACE, groups_by_hand, lower, quality_by_hand, shards_by_hand, shingles_of, water

BASE = "/root/testdata/sf0.001"


def _corpus():
    """(doc_id, text, lang, source), labels and items: low and toxic documents, near copies, passages of items, null and empty texts."""
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, docs, labels = prose(30), [], []
    for i in range(110):
        own = prose(rnd.randint(20, 160))
        if i % 4 == 0:
            own = [f"{w}###" for w in own]
        if i % 5 == 1:
            own += ["nasty", "vile"]
        docs.append((i, " ".join(own), ["en", None, "de"][i % 3], ["a", "b", None, "c"][i % 7 % 4]))
        if i % 8 != 7:
            labels.append((i, int(i % 4 != 0), int(i % 5 == 1)))
    for k in range(8):
        near = docs[90][1].split()
        near[k * 2] = f"changed{k}"
        docs.append((200 + k, " ".join(near), "en", "a"))
    docs += [(300 + k, " ".join([*prose(20), *passage[k : k + 12], *prose(9)]), "de", "b") for k in range(5)]
    docs += [(400, None, None, None), (401, "", "en", "c"), (402, docs[3][1], "en", "b"), (403, "one two", "en", "a")]
    items = [(1, " ".join(passage)), (2, "never to be found in there"), (3, None)]
    return docs, labels, items


def kept_quality(docs, labels, _):
    own, _ = quality_by_hand(docs, labels, 2.0)
    return Counter(d for d in docs if own[d[0]][0] < quality.REJECT["low"] and own[d[0]][1] < quality.REJECT["toxic"])


def kept_near(docs, labels, items):
    sets = [shingles_of(d[1], 5) for d in docs]
    group, out = groups_by_hand(docs, sets), {}
    for d, g, s in zip(docs, group, sets):
        key = (g, None) if s else (None, d)
        out[key] = min(out.get(key, d), d, key=lambda x: x[0])
    return Counter(out.values())


def kept_clean(docs, labels, items):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    windows = set()
    for _, x in items:
        w = split(x)
        m = min(10, len(w))
        windows |= {tuple(w[j : j + m]) for j in range(len(w) - m + 1) if m}
    hit = lambda w: any(tuple(w[j : j + m]) in windows for m in {len(k) for k in windows} for j in range(len(w) - m + 1))
    return Counter(d for d in docs if not hit(split(d[1])))


def taken_mix(docs, labels, items):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    hashed = lambda d: int(md5(f"{d[0]}:{md5(d[1] or '')}")[:10], 16)
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {d[0]: len(SPACE.findall(d[1] or "")) for d in docs}
    own = [sum(size[d[0]] for d in docs if d[3] == s) for s in sources]
    out = Counter()
    for s, n, goal in zip(sources, own, water(own, [(3, 1, 2)[i % 3] for i in range(len(own))], 1.5, 2)):
        whole = int(goal // n) if n else 1
        rest, before = max(0.0, goal - whole * n), 0
        for d in sorted((d for d in docs if d[3] == s), key=hashed):
            more = before + size[d[0]] <= rest or (before <= rest and before + size[d[0]] - rest < rest - before)
            out[d] += whole + (1 if more and whole < 2 else 0)
            before += size[d[0]]
    return +out


def test_each_stage_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "DEVIATION", 2.0)
    docs, labels, items = _corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    by_hand = {"quality": kept_quality, "near_duplicates": kept_near, "decontamination": kept_clean, "mixing": taken_mix}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, frame, str(tmp_path)), name)
        got = Counter((r.doc_id, r.text, r.lang, r.source) for r in after.collect())
        if name == "sharding":
            assert got == Counter(docs)
            own = Counter((r.doc_id, r.shard, r.slot) for r in after.collect())
            # Rows alike may stand in either order.
            assert Counter((i, s) for (i, s, _), n in own.items() for _ in range(n)) == Counter((k[0], k[3]) for k in shards_by_hand([d[:2] for d in docs], corpus_pipeline.SHARDS).elements())
            assert Counter((s, k) for (_, s, k) in own.elements()) == Counter((k[3], k[4]) for k in shards_by_hand([d[:2] for d in docs], corpus_pipeline.SHARDS).elements())
        else:
            want = by_hand[name](docs, labels, items)
            assert got == want, name
            assert name == "mixing" or 0 < sum(want.values()) < len(docs)  # each decides something
            assert after.columns == frame.columns
            docs = list(want.elements())
        frame = after


def test_empty_tables_go_through(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = none
    for name, stage in corpus_pipeline.STAGES:
        frame = written(stage(spark, frame, str(tmp_path)), name)
        assert frame.count() == 0 and (name == "sharding" or frame.columns == none.columns)


def test_awkward_documents_go_through(spark, docs, bench, tmp_path):
    spark.read.parquet(f"{BASE}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, frame, str(tmp_path)), name)
        assert name == "sharding" or after.columns == docs.columns
        frame = after
    assert frame.count() > 20 and {"shard", "slot"} <= set(frame.columns)


def test_run(spark):
    import os

    from pricewell.scratch import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    out = corpus_pipeline.run(spark, BASE)
    assert out.count() > 100 and {"shard", "slot"} <= set(out.columns)
    left = set(os.listdir(shared_dir(spark))) - before
    assert [p.split("-")[:2] for p in left] == [["pipeline", "sharding"]]  # the stages' other tables are gone, and what was consumed
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
