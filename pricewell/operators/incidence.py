"""Contributions of categories to the headline index, exact across basket changes.

inc = w(base's basket) * (x(t) - x(base)) / INPC(base). Within a basket x is the unlinked index J; across baskets the visible one, unless the
classification is stable: then [base, t] is split at the link periods it crosses and the segments' contributions are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ConfigurationProblem, InvariantBroken
from ..functions.periods import december_before, lag_of
from .laspeyres import small
from .variation import derived_state, ends, with_base


def weights(basket: DataFrame, classes: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """version, tipo, indice, ponderador of categories, under the names that the results use."""
    own = basket.join(classes.where("categoria is not null"), ["version", "generico"]).groupBy("version", "tipo", F.col("categoria").alias("indice")).agg(F.sum("ponderador").alias("ponderador"))
    if renames is None:
        return own
    named = own.join(renames, ["version", "tipo", "indice"], "left")
    return named.groupBy("version", "tipo", F.coalesce("nuevo", "indice").alias("indice")).agg(F.sum("ponderador").alias("ponderador"))


def check_inputs(indices: DataFrame, basket: DataFrame) -> None:
    """Raises unless indices hold the headline and categories of one periodicity, finite, with a basket for each version."""
    seen = indices.agg(F.count_if(F.col("tipo") == "INPC").alias("head"), F.count_if(F.col("tipo") != "INPC").alias("rest"), F.countDistinct("periodicidad").alias("kinds")).first()
    if not seen["head"] or not seen.rest:
        raise ConfigurationProblem("indices must hold the headline (tipo INPC) and categories")
    if seen.kinds != 1:
        raise ConfigurationProblem("headline and categories must have one periodicity")
    lacking = indices.select("version").distinct().join(basket.select("version").distinct(), "version", "left_anti").collect()  # a row a version
    if lacking:
        raise ConfigurationProblem(f"no basket for versions {sorted(r.version for r in lacking)}")
    off = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    bad = indices.where(off("indice_replicado") | off("indice_incidencia") | ((F.col("tipo") == "INPC") & (F.col("indice_replicado") == 0))).limit(1).collect()
    if bad:
        raise InvariantBroken(f"{bad[0].indice!r} at {bad[0].ord} is not finite, or a headline of 0")


def stable(classes: DataFrame, renames: DataFrame | None = None, item_renames: DataFrame | None = None) -> DataFrame:
    """tipo, estable: every version has the same categories and no item changes its category, after renames (item_renames: version, generico, nuevo_generico)."""
    own = classes.where("categoria is not null")
    if renames is not None:
        own = own.join(renames.withColumnRenamed("indice", "categoria"), ["version", "tipo", "categoria"], "left").withColumn("categoria", F.coalesce("nuevo", "categoria")).drop("nuevo")
    if item_renames is not None:
        own = own.join(item_renames, ["version", "generico"], "left").withColumn("generico", F.coalesce("nuevo_generico", "generico")).drop("nuevo_generico")
    versions = own.groupBy("tipo").agg(F.countDistinct("version").alias("versions"))
    by_class = own.groupBy("tipo", "categoria").agg(F.countDistinct("version").alias("n"))
    by_item = own.groupBy("tipo", "generico").agg(F.countDistinct("categoria").alias("n")).groupBy("tipo").agg(F.max("n").alias("moves"))
    fewest = by_class.groupBy("tipo").agg(F.min("n").alias("least"))
    return versions.join(fewest, "tipo").join(by_item, "tipo").select("tipo", ((F.col("versions") == F.col("least")) & (F.col("moves") == 1)).alias("estable"))


def segments(ranges: DataFrame) -> DataFrame:
    """ver_b, ver_t, ver_m, ini_junta, fin_junta: the baskets that a span from ver_b to ver_t crosses, with the link periods that open (null: the base) and close (null: t) each."""
    v = ranges.select("version", "ini", F.row_number().over(W.orderBy("ini")).alias("k"))
    b, t, m = (v.select(*(F.col(c).alias(f"{c}_{x}") for c in v.columns)) for x in "btm")
    spans = b.join(t, F.col("k_b") < F.col("k_t")).join(m, F.col("k_m").between(F.col("k_b"), F.col("k_t")))  # a few versions
    after = v.select((F.col("k") - 1).alias("k_m"), F.col("ini").alias("next_ini"))
    return spans.join(after, "k_m", "left").select(
        F.col("version_b").alias("ver_b"), F.col("version_t").alias("ver_t"), F.col("version_m").alias("ver_m"),
        F.when(F.col("k_m") > F.col("k_b"), F.col("ini_m")).alias("ini_junta"), F.when(F.col("k_m") < F.col("k_t"), F.col("next_ini")).alias("fin_junta"),
    )


def _anchors(indices: DataFrame, frontier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(tipo, indice, ord) → J and visible: of the result's own periods, and of link periods on the old side."""
    own = indices.select("tipo", "indice", "ord", F.col("indice_incidencia").alias("j"), F.col("indice_replicado").alias("i"))
    if frontier is None:
        return own, own
    return own, frontier.select("tipo", "indice", "ord", F.col("indice_incidencia_old").alias("j"), F.col("indice_replicado_old").alias("i"))


def _named(anchors: DataFrame, ord_: str, j: str, i: str) -> DataFrame:
    return anchors.select("tipo", "indice", F.col("ord").alias(ord_), F.col("j").alias(j), F.col("i").alias(i))


def _inpc(anchors: DataFrame, ord_: str, j: str, i: str) -> DataFrame:
    return anchors.where("tipo = 'INPC'").select(F.col("ord").alias(ord_), F.col("j").alias(j), F.col("i").alias(i))


def contributions(rows: DataFrame, indices: DataFrame, w: DataFrame, ranges: DataFrame, frontier: DataFrame | None) -> DataFrame:
    """tipo, indice, ord, cross_pp (null if an anchor is missing) of rows that cross baskets: the sum over their segments.

    f = visible / J at the segment's end, for category and headline; a segment that starts at a link period starts from the visible index there over f, so no
    scale is assumed. Months take the anchors at link periods from the frontier; without one (None on monthly input) pass an empty frame.
    """
    own, old = _anchors(indices, frontier)
    inner = rows.select("tipo", "indice", "ord", "base_ord", F.col("base.version").alias("ver_b"), F.col("version").alias("ver_t")).join(small(segments(ranges)), ["ver_b", "ver_t"])
    s = inner.join(w.withColumnRenamed("version", "ver_m"), ["ver_m", "tipo", "indice"], "left")
    s = s.join(_named(own, "ord", "j_t", "i_t"), ["tipo", "indice", "ord"], "left").join(_named(own, "base_ord", "j_b", "i_b"), ["tipo", "indice", "base_ord"], "left")
    s = s.join(_named(old, "fin_junta", "j_f", "i_f"), ["tipo", "indice", "fin_junta"], "left").join(_named(old, "ini_junta", "j_s", "i_s"), ["tipo", "indice", "ini_junta"], "left")
    s = s.join(_inpc(own, "ord", "p_j_t", "p_i_t"), "ord", "left").join(_inpc(own, "base_ord", "p_j_b", "p_i_b"), "base_ord", "left").join(_inpc(old, "fin_junta", "p_j_f", "p_i_f"), "fin_junta", "left")
    last = F.col("fin_junta").isNull()
    at = lambda t, f: F.when(last, F.col(t)).otherwise(F.col(f))
    j_end, i_end, pj_end, pi_end = at("j_t", "j_f"), at("i_t", "i_f"), at("p_j_t", "p_j_f"), at("p_i_t", "p_i_f")
    f_k, f_p = F.try_divide(i_end, j_end), F.try_divide(pi_end, pj_end)
    start = F.when(F.col("ini_junta").isNull(), F.col("j_b")).otherwise(F.try_divide(F.col("i_s"), f_k))
    part = F.try_divide(f_p * F.col("ponderador") * (j_end - start), F.col("p_i_b"))
    return s.groupBy("tipo", "indice", "ord").agg(F.when(~F.bool_or(part.isNull()), F.sum(part)).alias("cross_pp"))


def _core(rows: DataFrame, indices: DataFrame, w: DataFrame, ranges: DataFrame, steady: DataFrame, frontier: DataFrame | None, kind: str, monthly: bool) -> DataFrame:
    """rows: category rows with base_ord and base; indices: headline and categories."""
    head = indices.where("tipo = 'INPC'")
    at = lambda o, x: head.select(F.col("ord").alias(o), F.struct("version", "indice_incidencia", "indice_replicado", "estado_calculo").alias(x))
    both = rows.join(at("ord", "inpc_t"), "ord", "left").join(at("base_ord", "inpc_b"), "base_ord", "left")
    both = both.withColumn("ver_b", F.coalesce("base.version", "version"))
    cross_class = F.col("base.version").isNotNull() & (F.col("base.version") != F.col("version"))
    differs = F.coalesce(F.col("inpc_t.version") != F.col("version"), F.lit(False)) | F.coalesce(F.col("inpc_b.version") != F.col("ver_b"), F.lit(False))
    both = both.withColumn("cross_class", cross_class).withColumn("cross", cross_class | differs)
    both = both.join(w.select(F.col("version").alias("ver_b"), "tipo", "indice", F.col("ponderador").alias("ponderador_lag")), ["ver_b", "tipo", "indice"], "left")
    both = both.join(w.select("version", "tipo", "indice", F.col("ponderador").alias("ponderador_t")), ["version", "tipo", "indice"], "left")
    both = both.join(F.broadcast(steady), "tipo", "left")  # a row a classification
    exact = both.where("cross_class and estable").select("tipo", "indice", "ord", "base_ord", "version", "base")
    if monthly and frontier is None:
        frontier = indices.select("tipo", "indice", "ord", F.col("indice_incidencia").alias("indice_incidencia_old"), F.col("indice_replicado").alias("indice_replicado_old")).where("false")
    parts = contributions(exact, indices, w, ranges, frontier if monthly else None)
    both = both.join(parts, ["tipo", "indice", "ord"], "left")
    pick = lambda x: F.when(F.col("cross"), F.col(f"{x}indice_replicado")).otherwise(F.col(f"{x}indice_incidencia"))
    xt, xb, pb = pick(""), pick("base."), pick("inpc_b.")
    plain = F.try_divide((xt - xb) * F.col("ponderador_lag"), pb)
    segmented = F.col("cross_class") & F.coalesce("estable", F.lit(False))
    value = F.coalesce(F.when(segmented, F.col("cross_pp")), plain)
    method = F.when(~F.col("cross"), "within").when(segmented & F.col("cross_pp").isNotNull(), "cross_segmentado").when(segmented, "cross_sin_frontera").otherwise("cross_visible")
    why = F.when(xt.isNull(), "sin valor de clasificación en t").when(xb.isNull(), "sin valor de clasificación en periodo base").when(pb.isNull(), "sin INPC en periodo base").when(F.col("ponderador_lag").isNull(), "sin ponderador para el genérico en la canasta base").otherwise("incidencia no computable")
    computable = value.isNotNull()
    return both.select(
        "tipo", "periodicidad", "ord", "indice", F.lit(kind).alias("clase_incidencia"), computable.alias("computable"), value.alias("incidencia_pp"),
        F.when(computable, derived_state(F.col("estado_calculo"), F.col("base.estado_calculo"), F.col("inpc_b.estado_calculo"))).otherwise("sin_datos").alias("estado_calculo"),
        F.when(~computable, why).alias("motivo_error"), method.alias("metodo_incidencia"), F.col("base_ord").alias("ord_lag"), xt.alias("indice_t"), xb.alias("indice_lag"),
        "ponderador_t", "ponderador_lag", F.col("version").alias("version_t"), F.col("ver_b").alias("version_lag"),
    )


def _categories(indices: DataFrame) -> DataFrame:
    return indices.where("tipo <> 'INPC'")


def periodic(indices: DataFrame, w: DataFrame, ranges: DataFrame, steady: DataFrame, frequency: str, periodicity: str, frontier: DataFrame | None = None) -> DataFrame:
    """Against one frequency earlier, for every classification at once. indices holds headline (tipo INPC) and categories."""
    lag = lag_of(frequency, periodicity)
    return _core(with_base(_categories(indices), F.col("ord") - lag), indices, w, ranges, steady, frontier, f"periodica_{frequency}", periodicity == "M")


def year_to_date(indices: DataFrame, w: DataFrame, ranges: DataFrame, steady: DataFrame, periodicity: str, frontier: DataFrame | None = None) -> DataFrame:
    return _core(with_base(_categories(indices), december_before(F.col("ord"), periodicity)), indices, w, ranges, steady, frontier, "acumulada_anual", periodicity == "M")


def from_to(indices: DataFrame, w: DataFrame, ranges: DataFrame, steady: DataFrame, start: int, end: int, periodicity: str, partial: bool = True, frontier: DataFrame | None = None) -> DataFrame:
    """One row a category from start to end; base rows come from within the range only."""
    own = _categories(indices)
    found = ends(own, start, end, partial)
    ok = F.col("start_real").isNotNull() & F.col("end_real").isNotNull()
    at = found.select("tipo", "indice", F.when(ok, F.col("end_real")).otherwise(end).alias("ord"), F.when(ok, F.col("start_real")).otherwise(start).alias("_base"))
    rows = with_base(at.join(own, ["tipo", "indice", "ord"]), F.col("_base"), own.where(F.col("ord").between(start, end))).drop("_base")
    out = _core(rows, indices, w, ranges, steady, frontier, "desde", periodicity == "M")
    return out if partial else out.withColumn("computable", F.col("computable") & (F.col("estado_calculo") != "parcial"))
