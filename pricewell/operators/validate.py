"""Comparison with official figures: row absent = out of the published range, null value = a gap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationProblem

#: Tolerances of indices, and of variations and incidences in points.
INDEX_TOLERANCE, POINT_TOLERANCE = 0.0009, 0.009
STATES = ("ok", "diferencia_detectada", "diferencia_por_parcial", "no_disponible", "fuera_rango_inegi", "sin_calculo")


def compare(rows: DataFrame, official: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Adds oficial, error (null unless comparable) and estado_validacion. official: tipo, indice, ord, oficial.

    In this order: absent → fuera_rango_inegi; null → no_disponible; own value missing → sin_calculo; within the tolerance (inclusive) → ok;
    own parcial → diferencia_por_parcial; else diferencia_detectada.
    """
    if not (math.isfinite(tolerance) and tolerance >= 0):
        raise ConfigurationProblem("a tolerance must be finite and not negative")
    both = rows.join(official.select("tipo", "indice", "ord", "oficial", F.lit(True).alias("_there")), ["tipo", "indice", "ord"], "left")
    error = F.abs(F.col(value) - F.col("oficial"))
    lacks = F.col("estado_calculo").isin("sin_datos", "fallida") | F.col(value).isNull()
    state = (
        F.when(F.col("_there").isNull(), "fuera_rango_inegi").when(F.col("oficial").isNull(), "no_disponible").when(lacks, "sin_calculo")
        .when(error <= tolerance, "ok").when(F.col("estado_calculo") == "parcial", "diferencia_por_parcial").otherwise("diferencia_detectada")
    )
    both = both.withColumn("estado_validacion", state)
    comparable = F.col("estado_validacion").isin("ok", "diferencia_por_parcial", "diferencia_detectada")
    return both.withColumn("error", F.when(comparable, error)).drop("_there")


def failures(compared: DataFrame) -> DataFrame:
    return compared.where("estado_validacion <> 'ok'")


def _overall(prefix: str = "n_") -> Column:
    n = lambda s: F.col(f"{prefix}{s}")
    return (
        F.when(n("diferencia_detectada") > 0, "diferencia_detectada").when(n("diferencia_por_parcial") > 0, "diferencia_por_parcial")
        .when(n("sin_calculo") > 0, "sin_calculo").when(n("ok") == 0, "no_disponible").otherwise("ok")
    )


def summary(compared: DataFrame, *keys: str) -> DataFrame:
    """Counts by state, greatest error and overall state. Rows out of range never bear on it; without a comparable row it is no_disponible."""
    n = {s: F.count_if(F.col("estado_validacion") == s) for s in STATES}
    out = compared.groupBy(*keys).agg(F.count("*").alias("n_filas"), F.count("error").alias("n_comparables"), *(c.alias(f"n_{s}") for s, c in n.items()), F.max("error").alias("error_maximo"))
    return out.withColumn("estado_global", _overall())


def derived_summary(compared: DataFrame, *keys: str) -> DataFrame:
    """The same of variations or contributions, whose rows without a value take no part: only computable ones are counted, so that there is no sin_calculo.

    The state of the calculation and the first and last period come from the computable rows too; n_diagnostico counts all rows of the report that
    aren't ok, in the same pass.
    """
    own = F.col("computable")
    n = {s: F.count_if(own & (F.col("estado_validacion") == s)) for s in STATES}
    out = compared.groupBy(*keys).agg(
        F.when(F.bool_or(own & (F.col("estado_calculo") == "parcial")), "parcial").otherwise("ok").alias("estado_calculo"),
        F.min(F.when(own, F.col("ord"))).alias("desde"), F.max(F.when(own, F.col("ord"))).alias("hasta"), F.count_if(own).alias("n_filas"), F.count(F.when(own, F.col("error"))).alias("n_comparables"),
        *(c.alias(f"n_{s}") for s, c in n.items()), F.max(F.when(own, F.col("error"))).alias("error_maximo"), F.count_if(F.col("estado_validacion") != "ok").alias("n_diagnostico"),
    )
    return out.withColumn("estado_global", _overall()).drop("n_sin_calculo")
