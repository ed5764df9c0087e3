"""Laspeyres indices of every version and classification in one plan: trim, fill, chain factor, weighted group means, states and coverage.

Relations
- series: version, generico, ord, valor (null or absent = missing)
- basket: version, generico, ponderador, encadenamiento (null = none published)
- classes: version, generico, tipo, categoria (rows without a category take no part)
- ranges: version, ini, fin (null = open), metodo (directo, t1, t2); inclusive, a link period belongs to both versions
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import CalculationProblem, InvariantBroken

CHAINED = ("t1", "t2")
COVERAGE = ("genericos_esperados", "genericos_con_indice", "genericos_sin_indice", "cobertura_genericos_pct", "ponderador_esperado", "ponderador_cubierto")


def small(table: DataFrame) -> DataFrame:
    """A version table: one row a version, so it is broadcast."""
    return F.broadcast(table)


def trim(series: DataFrame, ranges: DataFrame) -> DataFrame:
    """Periods within the version's range only. It precedes the fill, so that no value crosses a link period."""
    both = series.join(small(ranges.select("version", "ini", "fin")), "version")
    return both.where((F.col("ord") >= F.col("ini")) & (F.col("fin").isNull() | (F.col("ord") <= F.col("fin")))).drop("ini", "fin")


def grid(trimmed: DataFrame, basket: DataFrame) -> DataFrame:
    """A row for every item of the basket and every period that its version has; items that only the series has are left out."""
    periods = trimmed.select("version", "ord").distinct()
    cells = basket.select("version", "generico").join(periods, "version")
    own = trimmed.groupBy("version", "generico", "ord").agg(F.max("valor").alias("valor"))
    return cells.join(own, ["version", "generico", "ord"], "left")


def fill(cells: DataFrame) -> DataFrame:
    """Missing values from the next period that has one, else from the last one before; fuente_ord is where a filled value comes from."""
    line = W.partitionBy("version", "generico").orderBy("ord")
    known = F.when(F.col("valor").isNotNull(), F.struct("valor", "ord"))
    ahead = F.first(known, ignorenulls=True).over(line.rowsBetween(W.currentRow, W.unboundedFollowing))
    behind = F.last(known, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = cells.withColumn("_f", F.coalesce(ahead, behind))
    return found.select("version", "generico", "ord", F.col("valor").alias("original"), F.col("_f.valor").alias("valor"), F.when(F.col("valor").isNull(), F.col("_f.ord")).alias("fuente_ord"))


def chain_factors(filled: DataFrame, basket: DataFrame, ranges: DataFrame) -> DataFrame:
    """version, generico, ponderador, f: 1 for direct versions, else the published factor, else the item's filled value at the version's first period / 100."""
    at_link = filled.join(small(ranges.select("version", "ini", "metodo")), "version").where((F.col("ord") == F.col("ini")) & F.col("metodo").isin(*CHAINED))
    at_link = at_link.select("version", "generico", (F.col("valor") / 100).alias("_link"))
    both = basket.join(small(ranges.select("version", "metodo")), "version").join(at_link, ["version", "generico"], "left")
    f = F.when(F.col("metodo").isin(*CHAINED), F.coalesce("encadenamiento", "_link")).otherwise(F.lit(1.0))
    return both.select("version", "generico", "ponderador", f.alias("f"))


def group_index(filled: DataFrame, factors: DataFrame, classes: DataFrame) -> DataFrame:
    """J = sum(w * x / f) / sum(w) by version, tipo, category and period, with state and coverage.

    The weights of all items count; a group with an item that is missing even after the fill has no value (sin_datos) and is never
    re-weighted. The same aggregation gives sum(w * f) / sum(w), the link factor of T2 without a reference.
    """
    rows = filled.join(factors, ["version", "generico"]).join(classes.where("categoria is not null"), ["version", "generico"])
    w, x = F.col("ponderador"), F.col("valor")
    out = rows.groupBy("version", "tipo", F.col("categoria").alias("indice"), "ord").agg(
        (F.sum(w * x / F.col("f")) / F.sum(w)).alias("_j"),
        (F.sum(w * F.col("f")) / F.sum(w)).alias("f_grupo"),
        F.bool_or(x.isNull()).alias("_falta"),
        F.bool_or(F.col("original").isNull() & x.isNotNull()).alias("_relleno"),
        F.count("*").alias("genericos_esperados"),
        F.count(x).alias("genericos_con_indice"),
        F.sum(w).alias("ponderador_esperado"),
        F.coalesce(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)).alias("ponderador_cubierto"),
    )
    return out.select(
        "version", "tipo", "indice", "ord", F.lit("Q").alias("periodicidad"),
        F.when(~F.col("_falta"), F.col("_j")).alias("indice_incidencia"), "f_grupo",
        F.when(F.col("_falta"), "sin_datos").when(F.col("_relleno"), "rellenado").otherwise("ok").alias("estado_calculo"),
        F.when(F.col("_falta"), "faltantes en serie").alias("motivo_error"),
        "genericos_esperados", "genericos_con_indice", (F.col("genericos_esperados") - F.col("genericos_con_indice")).alias("genericos_sin_indice"),
        (F.col("genericos_con_indice") * 100.0 / F.col("genericos_esperados")).alias("cobertura_genericos_pct"), "ponderador_esperado", "ponderador_cubierto",
    )


def raw_index(series: DataFrame, basket: DataFrame, classes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The unlinked index J of all versions and classifications; filling reads the series once for all of them."""
    filled = fill(grid(trim(series, ranges), basket))
    return group_index(filled, chain_factors(filled, basket, ranges), classes)


def link(raw: DataFrame, ranges: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Adds indice_replicado = J * h. references: version, tipo, indice, referencia (the index that the version's first period must have).

    h = referencia / J(first period) for direct and T1 versions, 1 without a reference; referencia / 100 for T2, f_grupo without one.
    """
    line = W.partitionBy("version", "tipo", "indice")
    own = raw.join(small(ranges.select("version", "ini", "metodo")), "version")
    own = own.withColumn("_at", F.max(F.when(F.col("ord") == F.col("ini"), F.col("indice_incidencia"))).over(line))
    if references is None:
        own = own.withColumn("referencia", F.lit(None).cast("double"))
    else:
        own = own.join(references, ["version", "tipo", "indice"], "left")
    h = F.when(F.col("metodo") == "t2", F.coalesce(F.col("referencia") / 100, F.col("f_grupo"))).otherwise(F.coalesce(F.try_divide("referencia", "_at"), F.lit(1.0)))
    return own.withColumn("indice_replicado", F.col("indice_incidencia") * h).drop("ini", "metodo", "_at", "referencia", "f_grupo")


def diagnostics(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """One row a cell that is missing or was filled, for each classification of its item."""
    cells = filled.where("original is null").join(classes.where("categoria is not null").select("version", "generico", "tipo"), ["version", "generico"])
    return cells.select("version", "tipo", "ord", "generico", F.lit("periodo").alias("nivel_faltante"), F.when(F.col("valor").isNull(), "indice").otherwise("relleno").alias("tipo_faltante"), "fuente_ord")


def check_basket(basket: DataFrame) -> None:
    """Raises if keys repeat or are empty, weights aren't positive or don't sum to 100 within 1e-5, or factors aren't positive."""
    bad = basket.groupBy("version").agg(
        (F.count("*") - F.countDistinct("generico")).alias("repeated"),
        F.count_if(F.trim("generico") == "").alias("empty"),
        F.count_if(F.coalesce(~(F.col("ponderador") > 0), F.lit(True))).alias("weights"),
        F.count_if(F.col("encadenamiento") <= 0).alias("factors"),
        F.abs(F.sum("ponderador") - 100).alias("off"),
    )
    for r in bad.where("repeated > 0 or empty > 0 or weights > 0 or factors > 0 or off > 1e-5 or off is null").limit(5).collect():
        raise InvariantBroken(f"basket {r.version}: {r.repeated} repeated or null items, {r['empty']} empty ones, {r.weights} weights and {r.factors} factors that aren't positive, weights off 100 by {r.off}")


def check_series(series: DataFrame) -> None:
    """Raises if values are negative or not finite, cells repeat or there is no period."""
    n = series.agg(F.count("*").alias("rows"), F.count_if(F.isnan("valor") | (F.col("valor") < 0) | (F.abs("valor") == float("inf"))).alias("invalid")).first()
    if not n.rows or n.invalid:
        raise InvariantBroken(f"series: {n.rows} rows, {n.invalid} values that are negative or not finite")
    if series.groupBy("version", "generico", "ord").count().where("count > 1").limit(1).count():
        raise InvariantBroken("series: items have several values in a period")


def check_coverage(series: DataFrame, basket: DataFrame) -> None:
    """Raises if an item of the basket is absent from its version's series; names the first three."""
    lacking = basket.select("version", "generico").join(series.select("version", "generico").distinct(), ["version", "generico"], "left_anti")
    first = [f"{r.generico} ({r.version})" for r in lacking.orderBy("generico", "version").limit(3).collect()]
    if first:
        raise CalculationProblem(f"items without a series: {', '.join(first)}")


def check_links(raw: DataFrame, ranges: DataFrame) -> None:
    """Raises if an index at its version's first period is 0 or null, so that it can't be linked."""
    at = raw.join(small(ranges), "version").where((F.col("ord") == F.col("ini")) & (F.col("metodo") != "t2") & (F.coalesce("indice_incidencia", F.lit(0.0)) == 0))
    r = at.limit(1).collect()
    if r:
        raise CalculationProblem(f"{r[0].indice} ({r[0].version}) has no index at its link period")
