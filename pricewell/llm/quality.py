"""Quality classifier by hierarchical empirical Bayes: word and layout evidence of a document, over site and path priors shrunk to the whole."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import minhash
from .common import blocks, few, masked, narrow_join, unmasked, utf8, written

#: Labelled rows to learn from, about; those with the least hashes of doc_id.
SAMPLE = 20_000
#: Features are hashed into 2 ** CELL_BITS cells, so what is learnt and broadcast has a fixed size. A cell bears on a label if LEAST sampled documents
#: have it, if the labelled ones among them deviate by DEVIATION standard errors from what their lengths and languages let expect, and if its
#: log likelihood ratio is EFFECT at least: many common words that each say next to nothing would add up.
CELL_BITS, LEAST, DEVIATION, EFFECT = 20, 5, 6.0, 1.0
#: Strata of that expectation: classes of length (powers of two) for each of LANGUAGES hashed languages; documents that the whole's rate counts as.
LENGTHS, LANGUAGES, STRATUM_DOCS = 32, 8, 20.0
#: Documents that a site's (or path's) own rate must outweigh.
PRIOR_DOCS = 50.0
#: Tokens of a block whose distinct ones are counted; words of a passage whose evidence is weighed as one.
BLOCK, PASSAGE = 100, 1_000
LABELS = ("low", "toxic")
#: Posteriors from which a document is rejected. Single words make weak cases of toxicity, so that one asks for more.
REJECT = {"low": 0.9, "toxic": 0.99}

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
_ENDS = frozenset(_MARKS) - frozenset(b".,;:!?)\"'")


def _level(share: float) -> int:
    """Classes of a share by quarters: 0 below a 64th (long texts seldom have none at all), 3 from a quarter on."""
    return 0 if share <= 0 else max(0, min(3, int(4 + math.log2(share) / 2)))


def layout(text: bytes) -> list[bytes]:
    """How a text is set, as shares that don't depend on its length: kinds of characters, of words and of lines.

    Shares are of five words, or 25 bytes, more than there are, so that a text of a few words shows nothing extreme.
    """
    tokens = text.split()
    n, size = len(tokens) + 5, len(text) + 25
    without = lambda some: (len(text) - len(text.translate(None, some))) / size
    lines = [x for x in text.split(b"\n") if x]
    # By blocks, since the share of distinct tokens of a whole text falls with its length.
    kinds = sum(len(set(tokens[i : i + BLOCK])) for i in range(0, len(tokens), BLOCK))
    return [
        b"|upper %d" % _level(without(_UPPER)),
        b"|digits %d" % _level(without(_DIGITS)),
        b"|marks %d" % _level(without(_MARKS)),
        b"|bare marks %d" % _level(sum(not t.translate(None, _MARKS) for t in tokens) / n),
        b"|odd ends %d" % _level(sum(t[-1] in _ENDS for t in tokens) / n),
        b"|twice %d" % _level(sum(map(bytes.__eq__, tokens, tokens[1:])) / n),
        b"|kinds %d" % int((kinds + 5) / n * 5),
        b"|word size %d" % (len(text) // (len(tokens) or 1)).bit_length(),
        b"|same lines %d" % _level(sum(map(bytes.__eq__, lines, lines[1:])) / (len(lines) + 3)),
    ]


def _cells(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes >> K.U(64 - CELL_BITS)).astype(np.int64)


@functools.lru_cache(maxsize=1024)  # there are a few dozen
def _layout_hash(feature: bytes) -> int:
    return int.from_bytes(K.digest(feature)[:8], "little")


def _hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the hashes of its layout features, and of its lower-case words in order."""
    h, at = K.word_hashes([x.translate(K.SPACED) for x in texts])
    for i, x in enumerate(texts):
        yield np.array([_layout_hash(f) for f in layout(x)], np.uint64), h[at[i] : at[i + 1]]


def cells(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """Of each text the cells of its layout features and words (each once, in order), and how many different words it has."""
    for some, words in _hashed(texts):
        yield _cells(np.concatenate([some, words])), len(np.unique(words))


def weighed(texts: list[bytes], ratios: np.ndarray) -> Iterator[tuple[float, float, int]]:
    """Of each text the log likelihood ratios of LABELS, and how many different words it has.

    Words count once a passage. A text is of low quality as its passages are on the whole (their mean, by words), and toxic as its most toxic passage
    is, so that neither grows with the text's length.
    """
    for some, words in _hashed(texts):
        parts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [words]
        each = np.array([ratios[_cells(p)].sum(axis=0) for p in parts])
        low, toxic = ratios[_cells(some)].sum(axis=0)
        size = np.array([len(p) for p in parts])
        yield float(low + (each[:, 0] * size).sum() / max(1, size.sum())), float(toxic + each[:, 1].max()), len(np.unique(words))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text, low, toxic of about SAMPLE labelled documents without near copies of each other.

    Hundreds of copies of one labelled text would make each of its words look telling. A document stays if it has the least doc_id in all its
    MinHash buckets (5-word shingles), or has no shingles.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    known = written(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "quality-labels")
    rows = written(narrow_join(docs.select("doc_id", "lang", utf8().alias("text")), known, "doc_id", most=4 * SAMPLE), "quality-sample")
    sets = minhash.signed(rows.select("doc_id", F.col("text").cast("string").alias("text")), minhash.Spec())
    held = sets.where("buckets is not null").select("doc_id", F.explode("buckets").alias("bucket"))
    least = held.groupBy("bucket").agg(F.min("doc_id").alias("least"))
    copies = written(held.join(least, "bucket").where("doc_id <> least").select("doc_id").distinct(), "quality-copies")
    return narrow_join(rows, copies, "doc_id", "left_anti", most=4 * SAMPLE)


def stratum(lang: str | None, n_kinds: int) -> int:
    """A document's class of length and language. Words and layout that are common in long texts, or in one language, are compared within these."""
    return min(n_kinds.bit_length(), LENGTHS - 1) + LENGTHS * (0 if lang is None else _layout_hash(lang.encode()) % LANGUAGES)


def counted(rows: DataFrame) -> DataFrame:
    """cell, stratum, n, low, toxic: sampled documents that have the cell, summed in Spark; the cell -1 counts all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            langs, marks = batch.column("lang").to_pylist(), [batch.column(c).to_numpy() for c in LABELS]
            own = list(cells(texts))
            key = [np.append(c, -1) * LENGTHS * LANGUAGES + stratum(lang, n) for (c, n), lang in zip(own, langs, strict=True)]
            size = [len(k) for k in key]
            kind, place, n = np.unique(np.concatenate(key), return_inverse=True, return_counts=True)
            sums = [np.bincount(place, np.repeat(m, size), len(kind)).astype(np.int64) for m in marks]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(n.astype(np.int64)), *map(pa.array, sums)], names=["key", "n", *LABELS])

    g = rows.select("lang", "text", *LABELS).mapInArrow(count, "key long, n long, low long, toxic long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", *LABELS)))
    wide = LENGTHS * LANGUAGES
    stratum_ = F.pmod("key", F.lit(wide)).cast("int")
    return written(g.select(((F.col("key") - stratum_) / wide).cast("long").alias("cell"), stratum_.alias("stratum"), "n", *LABELS), "quality-counts")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, tuple[float, ...]]:
    """The log likelihood ratio of each cell for LABELS, and the labels' rates.

    Both labels learn from all features. A label's documents that have a cell are compared with those expected by the rates of the strata, each
    shrunk to the whole by STRATUM_DOCS. Labels of missing documents, null labels and null ids teach nothing.
    """
    counts = counted(sampled(docs, labels))
    strata = counts.where("cell = -1").collect()  # LENGTHS * LANGUAGES rows at most
    total = sum(r.n for r in strata)
    out = np.zeros((1 << CELL_BITS, len(LABELS)))
    rates = []
    for k, label in enumerate(LABELS):
        p = sum(r[label] for r in strata) / total if total else 0.0
        if not 0 < p < 1:
            rates.append(0.01)
            continue
        rates.append(min(0.99, max(0.01, p)))
        by = {r.stratum: (r[label] + STRATUM_DOCS * p) / (r.n + STRATUM_DOCS) for r in strata}
        rate = F.element_at(F.create_map(*(F.lit(x) for s, q in by.items() for x in (s, q))), F.col("stratum"))
        each = counts.where("cell >= 0").withColumn("p", rate).groupBy("cell").agg(
            F.sum("n").alias("n"), F.sum(label).alias("y"), F.sum(F.col("n") * F.col("p")).alias("e"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("v")
        )
        for r in each.where((F.col("n") >= LEAST) & (F.abs(F.col("y") - F.col("e")) > DEVIATION * F.sqrt("v"))).toLocalIterator():
            ratio = math.log((r.y + 0.5) / (r.e + 0.5)) - math.log((r.n - r.y + 0.5) / (r.n - r.e + 0.5))
            out[r.cell, k] = ratio if abs(ratio) >= EFFECT else 0.0
    return out, tuple(rates)


def evidence(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, source, lang, n_kinds (distinct words), t, and the log likelihood ratios low_llr, toxic_llr of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 16 bytes a cell
    names = ["doc_id", "source", "lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in blocks(batches):
            low, toxic, n = zip(*weighed(texts, own), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "t")), pa.array(n, pa.int64()), pa.array(low, pa.float64()), pa.array(toxic, pa.float64())], names=[*names, "t", "n_kinds", "low_llr", "toxic_llr"])

    some = docs.select(*names, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"), utf8().alias("text"))
    types = dict(some.dtypes)
    return some.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", t long, n_kinds long, low_llr double, toxic_llr double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, rates: tuple[float, float]) -> DataFrame:
    """Adds low and toxic, the posterior probabilities, to scored documents.

    The documents' probabilities under the global rate are averaged by site and by path (a site's language) in grouped aggregations. A path's prior is
    its mean shrunk to its site's by PRIOR_DOCS documents, and the site's is shrunk likewise to the whole; the evidence is then added to the path's prior.
    Null sites and languages are groups of their own.
    """
    own = {}
    for label, rate in zip(LABELS, rates, strict=True):
        own[f"{label}_p"] = 1 / (1 + F.exp(-(F.col(f"{label}_llr") + math.log(rate / (1 - rate)))))
    soft = scored.withColumns(own)
    path = written(soft.groupBy("source", "lang").agg(F.count("*").alias("n"), *(F.sum(f"{x}_p").alias(x) for x in LABELS)), "quality-paths")
    site = path.groupBy("source").agg(F.sum("n").alias("site_n"), *(F.sum(x).alias(f"site_{x}") for x in LABELS))
    whole = path.agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in LABELS)).first()  # one row
    prior = path.join(site.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    for x in LABELS:
        top = (whole[x] or 0.0) / max(1, whole.n or 0)
        mid = (F.col(f"site_{x}") + PRIOR_DOCS * top) / (F.col("site_n") + PRIOR_DOCS)
        prior = prior.withColumn(f"{x}_prior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col(x) + PRIOR_DOCS * mid) / (F.col("n") + PRIOR_DOCS))))
    prior = written(prior.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "low_prior", "toxic_prior"), "quality-priors")
    on = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang"))
    out = scored.join(F.broadcast(prior) if few(prior) else prior, on).drop("_source", "_lang")
    return out.withColumns({x: 1 / (1 + F.exp(-(F.col(f"{x}_llr") + _logit(F.col(f"{x}_prior"))))) for x in LABELS})


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, lang, n_kinds (distinct words), evidence, priors, the posteriors low and toxic, kept; t, a hash of the text, tells rows of one doc_id apart.

    A document is rejected if it is low or toxic with a posterior of its REJECT or more. Null and empty texts have only the layout of an empty text. Without
    labels of both kinds nothing is learnt and nothing rejected. Repeated rows are documents of their own. Columns beside doc_id, text, source and lang
    are not used, whatever their names. A very long text is one block of a task, and all of its words count.
    """
    ratios, rates = learn(docs, labels)
    scored = written(evidence(docs, ratios), "quality-evidence")
    return posteriors(scored, rates).withColumn("kept", (F.col("low") < REJECT["low"]) & (F.col("toxic") < REJECT["toxic"]))


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select("doc_id", "n_kinds", *(F.round(c, 6).alias(c) for c in ("low_prior", "toxic_prior", "low", "toxic")), "kept")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns as they were."""
    gone = written(score(docs, labels).where("not kept").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct(), "quality-rejected")
    rows = masked(docs, "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    return unmasked(rows.join(F.broadcast(gone) if few(gone) else gone, on, "left_anti"), docs.columns)
