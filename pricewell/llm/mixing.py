"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, masked, narrow_join, unmasked, written

#: Bits of a hash that each level of the histogram resolves, and the levels.
BITS, LEVELS = 10, 4


def words_in(text: str = "text") -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def hash_of(*keys: Column) -> Column:
    """BITS * LEVELS bits of the keys' MD5, which other engines have too; null counts as an empty string."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """source, source_size, target: the budget shared by weight, none above `most` times its source's size.

    sizes has one row a source (null is a source). Filling sources in order of most * size / weight, those that reach their cap are
    the first ones: a source is capped if the level at which the rest would stand is above its own ratio.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    own = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    own = own.withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    own = own.withColumn("at", F.row_number().over(order)).withColumn("level", level).withColumn("open", F.col("level") < F.col("cap") / F.col("w"))
    # The level that holds is the one of the first source that stays below its cap.
    held = F.min(F.when(F.col("open"), F.struct("at", "level")))
    own = own.withColumn("held", held.over(every)["level"])
    return own.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("held") * F.col("w")), F.col("cap")).alias("target"))


def _cut(keyed: DataFrame, open_: DataFrame, h: str) -> DataFrame:
    """sid, low, rest, last: of each source, rows whose hash lies below `low` take part of its rest; what is left of it, and the words at `low` itself.

    open_ has sid and rest. Sums by source and the hash's first BITS bits show in which cell the rest is met; only that cell's rows are summed again
    by the next bits, and so on. `last` is null where all of a source's rows are below.
    """
    bounds = written(open_.select("sid", "rest", F.lit(0).cast("long").alias("low")), "mix-bounds")
    for k in range(1, LEVELS + 1):
        width = 1 << BITS * (LEVELS - k)
        near = narrow_join(keyed.select("sid", F.col(h).alias("h"), "size"), bounds.select("sid", "rest", "low"), "sid")
        inside = near.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * (1 << BITS)))
        cells = inside.groupBy("sid", "low", "rest", F.expr(f"(h - low) div {width}").alias("cell")).agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
        upto = F.coalesce(F.sum("sum").over(W.partitionBy("sid").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = cells.withColumn("before", upto).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
        # A source whose rest reaches past its last cell has no boundary cell: all its hashes are below.
        found = hit.select("sid", (F.col("rest") - F.col("before")).alias("rest2"), (F.col("low") + F.col("cell") * width).alias("low2"), F.col("sum").alias("last"), "rows")
        past = F.when(F.col("rest") > 0, F.col("low") + width * (1 << BITS)).otherwise(F.col("low"))
        bounds = written(bounds.select("sid", "rest", "low").join(found, "sid", "left").select("sid", F.coalesce("rest2", "rest").alias("rest"), F.coalesce("low2", past).alias("low"), "last", "rows"), f"mix-bounds{k}")
    return bounds


def _threshold() -> Column:
    """The last cell is taken whole if that comes nearer to the target."""
    return F.col("low") + F.when(F.col("last").isNotNull() & (F.col("last") - F.col("rest") < F.col("rest")), 1).otherwise(0)


def mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """Adds source_size, target and copies to written rows with source, size, h and tie (hashes of BITS * LEVELS bits); all their columns stay.

    A target of q times the source's size takes each row floor(q) times, and once more the rows whose hash h lies below a threshold, found by
    histograms of nested cells (_cut). The last cell is one hash: most often one row. Where several rows share it (rows alike in doc_id and
    text), the same search over their `tie`, a hash of the row's place in the table, splits them. No row is sorted. Null sources are one source.
    A source of no words has copies 1 and target 0.
    """
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = targets(sizes, weights, budget, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1))
    plan = plan.withColumn("open", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = written(plan.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))), "mix-plan")
    ids = plan.select(F.col("source").alias("_s"), "sid")
    keyed = rows.join(F.broadcast(ids) if few(ids) else ids, rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    first = _cut(keyed, plan.select("sid", F.col("open").alias("rest")), "h")
    shared = first.where("rows > 1")
    ends = first.select("sid", F.lit(-1).cast("long").alias("cell"), _threshold().alias("upto"), F.lit(0).cast("long").alias("tie_upto"))
    if shared.limit(1).count():
        at = shared.select("sid", F.col("low").alias("cell"), "rest")
        inside = written(narrow_join(keyed.select("sid", "h", "tie", "size"), at, "sid").where("h = cell").select("sid", "tie", "size"), "mix-alike")
        second = _cut(inside, at, "tie").select("sid", _threshold().alias("tie_upto"))
        split = shared.join(second, "sid").select("sid", F.col("low").alias("cell"), F.col("low").alias("upto"), "tie_upto")
        ends = ends.join(shared.select("sid"), "sid", "left_anti").unionByName(split)
    plan = written(plan.join(ends, "sid").select("sid", "source_size", "target", "whole", "cell", "upto", "tie_upto"), "mix-thresholds")
    out = narrow_join(keyed, plan, "sid")
    taken = (F.col("h") < F.col("upto")) | ((F.col("h") == F.col("cell")) & (F.col("tie") < F.col("tie_upto")))
    return out.withColumn("copies", (F.col("whole") + F.when(taken & (F.col("whole") < most), 1).otherwise(0)).cast("long")).drop("sid", "whole", "cell", "upto", "tie_upto")


def _keys(text: str = "text") -> list[Column]:
    """size, h and tie of documents, in one pass over the texts. The hash is of doc_id and text, so reruns agree."""
    return [words_in(text).alias("size"), hash_of(F.col("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("h"), hash_of(F.monotonically_increasing_id()).alias("tie")]


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h and tie of all documents, as a written table."""
    return written(docs.select("doc_id", "source", *_keys()), "mix-rows")


def document_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents; null text has size 0.

    Rows alike in doc_id and text are documents of their own. Columns beside doc_id, text and source are not used, whatever their names. A very
    long text is one row, counted by expressions.
    """
    return mix(slim(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them (0, 1 or 2 times), all columns as they were. They are written once with their keys, and no join moves them."""
    rows = written(masked(docs, "source", *_keys()), "mix-documents")
    taken = mix(rows).where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unmasked(taken, docs.columns)
