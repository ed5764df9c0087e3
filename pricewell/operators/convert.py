"""History of an index: references from version to version, splice, rebase, months and the anchors at link periods."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvariantBroken
from ..scratch import written
from .laspeyres import link, small

WITH_VALUE = ("ok", "parcial", "rellenado")
SEVERITY = ("ok", "rellenado", "parcial", "sin_datos", "fallida")


def severity(state: Column) -> Column:
    return F.element_at(F.create_map(*(x for i, s in enumerate(SEVERITY) for x in (F.lit(s), F.lit(i)))), state)


def renamed(indices: DataFrame, renames: DataFrame | None) -> DataFrame:
    """Category names of each version in the vocabulary of one version; renames: version, tipo, indice, nuevo. Of two that fall together the first in the alphabet stays."""
    if renames is None:
        return indices
    out = indices.join(F.broadcast(renames), ["version", "tipo", "indice"], "left") if renames.limit(100_001).count() <= 100_000 else indices.join(renames, ["version", "tipo", "indice"], "left")
    out = out.withColumn("_old", F.col("indice")).withColumn("indice", F.coalesce("nuevo", "indice")).drop("nuevo")
    first = W.partitionBy("version", "tipo", "ord", "indice").orderBy("_old")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_old")


def linked_history(raw: DataFrame, ranges: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """All versions on one scale: each version's reference is the visible index of the one before at the link period.

    Only the rows at link periods take part in the fold over versions, one row a category and version; the series itself is linked once.
    """
    versions = [r.asDict() for r in ranges.orderBy("ini").collect()]  # a row a version
    named = written(renamed(raw, renames), "raw-index")  # read by every step of the fold
    ends = named.join(small(ranges.select(F.col("ini").alias("ord")).distinct()), "ord")
    references = None
    for before, v in zip(versions, versions[1:], strict=False):
        one = link(ends.where(F.col("version") == before["version"]), ranges, references)
        seen = one.where((F.col("ord") == v["ini"]) & F.col("indice_replicado").isNotNull())
        own = seen.select(F.lit(v["version"]).alias("version"), "tipo", "indice", F.col("indice_replicado").alias("referencia"))
        references = written(own if references is None else references.unionByName(own), "references")
    return link(named, ranges, references)


def splice(indices: DataFrame) -> DataFrame:
    """One row a period and category: the older version owns a link period where it has the row."""
    own = W.partitionBy("tipo", "ord", "indice").orderBy("version")
    return indices.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def shared_periods(spans: DataFrame) -> DataFrame:
    """a, b, vecinos, n_compartidos, compartido (the first one), roto: every pair of spans (column _tramo, from 0 by time), and whether it breaks the rule.

    Neighbours share exactly one period, others none. One pass over the distinct periods of each span; pairs of spans are few.
    """
    periods = spans.select("_tramo", "ord").distinct()
    both = periods.groupBy("ord").agg(F.sort_array(F.collect_set("_tramo")).alias("t")).where(F.size("t") > 1)
    pair = F.explode(F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    counts = both.select("ord", pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.min("ord").alias("compartido"))
    ids = periods.select("_tramo").distinct()
    every = ids.select(F.col("_tramo").alias("a")).join(F.broadcast(ids.select(F.col("_tramo").alias("b"))), F.col("a") < F.col("b"))  # a row a pair of spans
    near, n = F.col("b") == F.col("a") + 1, F.coalesce("n", F.lit(0))
    return every.join(F.broadcast(counts), ["a", "b"], "left").select("a", "b", near.alias("vecinos"), n.alias("n_compartidos"), "compartido", (n != F.when(near, 1).otherwise(0)).alias("roto"))


def check_spans(spans: DataFrame) -> list[int]:
    """The period that each span shares with the next; raises with every broken pair if any is."""
    pairs = shared_periods(spans).orderBy("a", "b").collect()  # a row a pair of spans
    broken = [f"{r.a} and {r.b} share {r.n_compartidos}" for r in pairs if r.roto]
    if broken:
        raise InvariantBroken(f"spans must share one period with the next and none with others: {'; '.join(broken)}")
    return [r.compartido for r in pairs if r.vecinos]


def first_of(spans: DataFrame) -> DataFrame:
    """One row a classification, period and category: the earlier span's where it has one; of names that fell together the first in the alphabet (_old)."""
    own = W.partitionBy("tipo", "ord", "indice").orderBy("_tramo", "_old")
    return spans.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_tramo", "_old")


def rebase(indices: DataFrame, ord_ref: int, base: float = 100.0, check: bool = True) -> DataFrame:
    """The visible index with `base` at a period; J stays. Categories without a row there keep their scale (a warning says which)."""
    at = F.max(F.when(F.col("ord") == ord_ref, F.struct("estado_calculo", "indice_replicado"))).over(W.partitionBy("tipo", "indice"))
    if check:
        rows = indices.where(F.col("ord") == ord_ref)
        n = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("estado_calculo").isin(*WITH_VALUE) | F.col("indice_replicado").isNull() | (F.col("indice_replicado") == 0)).alias("bad")).first()
        if not n.n:
            raise InvariantBroken("no category has a row at the reference period")
        if n.bad:
            raise InvariantBroken(f"{n.bad} categories have no usable value at the reference period")
        orphans = [r.indice for r in indices.select("tipo", "indice").distinct().join(rows.select("tipo", "indice"), ["tipo", "indice"], "left_anti").orderBy("indice").limit(20).collect()]
        if orphans:
            warnings.warn(f"not rebased, without a row at the reference period: {orphans}", stacklevel=2)
    out = indices.withColumn("_at", at)
    scaled = F.when(F.col("estado_calculo").isin(*WITH_VALUE) & F.col("_at").isNotNull(), F.col("indice_replicado") * (F.lit(float(base)) / F.col("_at.indice_replicado"))).otherwise(F.col("indice_replicado"))
    return out.withColumn("indice_replicado", scaled).drop("_at")


def frontier(indices: DataFrame, ranges: DataFrame) -> DataFrame:
    """Anchors at the link periods of spliced half months: what the older version has there. A month's mean would lose them."""
    order = W.orderBy("ini")
    steps = ranges.select(F.col("ini").alias("ord"), F.lag("version").over(order).alias("_old"), F.col("version").alias("version_new")).where("_old is not null")
    present = indices.select("tipo", "version").distinct()
    both = indices.join(small(steps), "ord").join(present.withColumnRenamed("version", "_old"), ["tipo", "_old"], "left_semi").join(present.withColumnRenamed("version", "version_new"), ["tipo", "version_new"], "left_semi")
    return both.select("tipo", "ord", "indice", F.col("version").alias("version_old"), "version_new", F.col("indice_incidencia").alias("indice_incidencia_old"), F.col("indice_replicado").alias("indice_replicado_old"))


def to_months(indices: DataFrame) -> DataFrame:
    """Months from half months, one aggregation by category and month.

    Both halves: their mean, rellenado if either is; one: its value, parcial; none: sin_datos; a failed half: fallida without a value.
    Version and classification come from the second half, else the first. Coverage takes the worse half; its structural columns the second one.
    """
    half = lambda c, q: F.max(F.when(F.col("ord") % 2 == q - 1, F.col(c)))
    names = ["version", "indice_replicado", "indice_incidencia", "estado_calculo", "motivo_error"]
    aggs = [half(c, q).alias(f"{c}{q}") for c in names for q in (1, 2)]
    structural = [c for c in ("genericos_esperados", "ponderador_esperado") if c in indices.columns]
    worst = [c for c in ("genericos_con_indice", "cobertura_genericos_pct", "ponderador_cubierto") if c in indices.columns]
    most = [c for c in ("genericos_sin_indice",) if c in indices.columns]
    aggs += [F.coalesce(half(c, 2), half(c, 1)).alias(c) for c in structural] + [F.min(c).alias(c) for c in worst] + [F.max(c).alias(c) for c in most]
    g = indices.groupBy("tipo", F.floor(F.col("ord") / 2).cast("int").alias("ord"), "indice").agg(*aggs)
    failed1, failed2 = (F.coalesce(F.col(f"estado_calculo{q}") == "fallida", F.lit(False)) for q in (1, 2))
    failed = failed1 | failed2
    has1, has2 = F.col("indice_replicado1").isNotNull(), F.col("indice_replicado2").isNotNull()
    filled = F.coalesce(F.col("estado_calculo1") == "rellenado", F.lit(False)) | F.coalesce(F.col("estado_calculo2") == "rellenado", F.lit(False))
    value = lambda c: F.when(~failed & has1 & has2, (F.col(f"{c}1") + F.col(f"{c}2")) / 2).when(~failed & (has1 | has2), F.coalesce(f"{c}1", f"{c}2"))
    state = F.when(failed, "fallida").when(has1 & has2 & filled, "rellenado").when(has1 & has2, "ok").when(has1 | has2, "parcial").otherwise("sin_datos")
    why = F.when(failed, F.when(failed1, F.col("motivo_error1")).otherwise(F.col("motivo_error2"))).when(~has1 & ~has2, F.coalesce("motivo_error2", "motivo_error1"))
    return g.select(
        F.coalesce("version2", "version1").alias("version"), "tipo", "indice", "ord", F.lit("M").alias("periodicidad"),
        value("indice_incidencia").alias("indice_incidencia"), state.alias("estado_calculo"), why.alias("motivo_error"), *structural, *worst, *most, value("indice_replicado").alias("indice_replicado"),
    )


def summary(indices: DataFrame) -> DataFrame:
    """Per version and classification: first and last period, rows, worst state."""
    return indices.groupBy("version", "tipo").agg(F.min("ord").alias("desde"), F.max("ord").alias("hasta"), F.count("*").alias("filas"), F.max_by("estado_calculo", severity(F.col("estado_calculo"))).alias("estado_peor"))
