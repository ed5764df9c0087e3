"""Variations of a visible index against an exact calendar base; one frame carries computable rows, report and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvariantBroken
from ..functions.periods import december_before, lag_of

#: What a base row brings along.
BASE = ("indice_replicado", "indice_incidencia", "estado_calculo", "version", "cobertura_genericos_pct")


def with_lag(indices: DataFrame, lag: int) -> DataFrame:
    """Adds base (a struct, null without a row) from exactly `lag` periods before: a calendar lag by a range frame, no row lag and no join."""
    frame = W.partitionBy("tipo", "indice").orderBy("ord").rangeBetween(-lag, -lag)
    return indices.withColumn("base_ord", F.col("ord") - lag).withColumn("base", F.first(F.struct(*_base(indices))).over(frame))


def with_base(indices: DataFrame, base_ord: Column, lookup: DataFrame | None = None) -> DataFrame:
    """The same for a base that varies by row, by a join on (tipo, indice, period)."""
    lookup = indices if lookup is None else lookup
    other = lookup.select("tipo", "indice", F.col("ord").alias("base_ord"), F.struct(*_base(lookup)).alias("base"))
    return indices.withColumn("base_ord", base_ord).join(other, ["tipo", "indice", "base_ord"], "left")


def _base(indices: DataFrame) -> list[str]:
    return [c for c in BASE if c in indices.columns]


def derived_state(*states: Column) -> Column:
    """parcial if any source is, else ok."""
    partial = F.lit(False)
    for s in states:
        partial = partial | F.coalesce(s == "parcial", F.lit(False))
    return F.when(partial, "parcial").otherwise("ok")


def _with_variation(rows: DataFrame, kind: str) -> DataFrame:
    t, b = F.col("indice_replicado"), F.col("base.indice_replicado")
    computable = t.isNotNull() & b.isNotNull()
    why = F.when(t.isNull() & b.isNull(), "sin valor replicado en t ni en periodo base").when(b.isNull(), "sin valor replicado en periodo base").otherwise("sin valor replicado en t")
    cover = "cobertura_genericos_pct" in rows.columns
    none = F.lit(None).cast("double")
    return rows.select(
        "tipo", "periodicidad", "ord", "indice", F.lit(kind).alias("clase_variacion"), computable.alias("computable"),
        ((F.try_divide(t, b) - 1) * 100).alias("variacion_pp"),
        F.when(computable, derived_state(F.col("estado_calculo"), F.col("base.estado_calculo"))).otherwise("sin_datos").alias("estado_calculo"),
        F.when(~computable, why).alias("motivo_error"), F.col("base_ord").alias("ord_lag"), t.alias("indice_t"), b.alias("indice_lag"),
        F.col("version").alias("version_t"), F.col("base.version").alias("version_lag"),
        (F.col("cobertura_genericos_pct") if cover else none).alias("cobertura_pct_t"), (F.col("base.cobertura_genericos_pct") if cover else none).alias("cobertura_pct_lag"),
    )


def periodic(indices: DataFrame, frequency: str, periodicity: str) -> DataFrame:
    """Against the period one frequency earlier; all rows, `computable` tells those with a value."""
    return _with_variation(with_lag(indices, lag_of(frequency, periodicity)), f"periodica_{frequency}")


def year_to_date(indices: DataFrame, periodicity: str) -> DataFrame:
    """Against the last period of the year before."""
    return _with_variation(with_base(indices, december_before(F.col("ord"), periodicity)), "acumulada_anual")


def ends(indices: DataFrame, start: int, end: int, partial: bool) -> DataFrame:
    """tipo, indice, start_real, end_real within [start, end]: the exact ends where there is a value, else (if partial) the first and last with one; null if not computable."""
    valid = F.col("indice_replicado").isNotNull()
    g = indices.where(F.col("ord").between(start, end)).groupBy("tipo", "indice").agg(
        F.min(F.when(valid, F.col("ord"))).alias("first"), F.max(F.when(valid, F.col("ord"))).alias("last"),
        F.bool_or(valid & (F.col("ord") == start)).alias("has_start"), F.bool_or(valid & (F.col("ord") == end)).alias("has_end"),
    )
    real = lambda has, exact, other: F.when(has, F.lit(exact)).otherwise(F.col(other) if partial else F.lit(None).cast("int"))
    all_ = indices.select("tipo", "indice").distinct()
    return all_.join(g.select("tipo", "indice", real(F.col("has_start"), start, "first").alias("start_real"), real(F.col("has_end"), end, "last").alias("end_real")), ["tipo", "indice"], "left")


def from_to(indices: DataFrame, start: int, end: int | None = None, partial: bool = True) -> DataFrame:
    """One row a category from start to end, at its real end; `parcial_de_rango` marks ends that had to move. Without `partial`, rows derived from parcial values aren't computable."""
    end = indices.agg(F.max("ord")).first()[0] if end is None else end
    if end < start:
        raise InvariantBroken("the end precedes the start")
    found = ends(indices, start, end, partial)
    ok = F.col("start_real").isNotNull() & F.col("end_real").isNotNull()
    at = found.select("tipo", "indice", F.when(ok, F.col("end_real")).otherwise(end).alias("ord"), F.when(ok, F.col("start_real")).otherwise(start).alias("_base"), ok.alias("_ok"))
    rows = at.join(indices, ["tipo", "indice", "ord"], "left").withColumn("periodicidad", F.coalesce("periodicidad", F.lit(None)))
    out = _with_variation(with_base(rows, F.col("_base"), indices), "desde")
    out = out.join(at.select("tipo", "indice", ((F.col("ord") != end) | (F.col("_base") != start)).alias("parcial_de_rango"), "_ok"), ["tipo", "indice"])
    keep = F.col("computable") & F.col("_ok")
    if not partial:
        keep = keep & (F.col("estado_calculo") != "parcial")
    return out.withColumn("computable", keep).drop("_ok")


def values(rows: DataFrame, value: str = "variacion_pp") -> DataFrame:
    """The computable rows."""
    kind = "clase_variacion" if "clase_variacion" in rows.columns else "clase_incidencia"
    return rows.where("computable").select("tipo", "periodicidad", "ord", "indice", kind, value, "estado_calculo", "version_t")


def missing(rows: DataFrame) -> DataFrame:
    """The rows that aren't computable, with the reason."""
    return rows.where("not computable")


def check(rows: DataFrame, value: str = "variacion_pp") -> None:
    """Raises if nothing is computable, or a computable row has base 0 or a value that isn't finite."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    n = rows.where("computable").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if not n.n or n.bad:
        raise InvariantBroken(f"{n.n} computable rows, {n.bad} of them with a base of 0 or no finite result")
