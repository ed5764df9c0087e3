"""The relational part of charts: panels, remainders of stacked bars, marked points. Drawing starts from toPandas()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import parse_as
from . import consult

#: Series in a panel; share that a stacked chart details; periods up to which points are drawn.
IN_PANEL, DETAILED_SHARE, POINTS = 8, 0.80, {"Q": 25, "M": 13}


def panels(rows: DataFrame, most: int = IN_PANEL, repeated: str = "INPC") -> DataFrame:
    """indice, panel: as few panels as hold `most` series, sizes differing by one at most; the headline is in each (panel null)."""
    names = rows.select("indice").distinct().where(F.col("indice") != repeated)  # categories: as many as a chart can name
    every = W.partitionBy(F.lit(0))
    r, n = F.row_number().over(every.orderBy("indice")) - 1, F.count("*").over(every)
    k = F.ceil(n / most)
    numbered = names.select("indice", r.alias("r"), F.floor(n / k).alias("q"), (n % k).alias("more"))
    wide = F.col("more") * (F.col("q") + 1)
    panel = F.when(F.col("r") < wide, F.floor(F.col("r") / (F.col("q") + 1))).otherwise(F.col("more") + F.floor((F.col("r") - wide) / F.col("q")))
    head = rows.where(F.col("indice") == repeated).select("indice", F.lit(None).cast("int").alias("panel")).distinct()
    return numbered.select("indice", panel.cast("int").alias("panel")).unionByName(head)


def detailed(rows: DataFrame, value: str, share: float = DETAILED_SHARE, least: int = IN_PANEL) -> DataFrame:
    """indice, magnitud of the categories to draw one by one: the largest mean magnitudes up to the share and one more, `least` at least."""
    size = rows.groupBy("indice").agg(F.avg(F.abs(value)).alias("magnitud"))
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.desc("magnitud"), "indice")
    total = F.sum("magnitud").over(every)
    upto = F.sum("magnitud").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = size.withColumns({"rank": F.row_number().over(order), "below": F.when(total > 0, (upto / total < share).cast("int")).otherwise(0)})
    ranked = ranked.withColumn("keep", F.greatest(F.sum("below").over(every) + 1, F.lit(least)))
    return ranked.where("rank <= keep").select("indice", "magnitud")


def remainders(rows: DataFrame, value: str) -> DataFrame:
    """Per period, the sums of what is not drawn one by one, positive and negative apart."""
    name = F.concat(F.lit("resto "), F.when(F.col(value) >= 0, "positivo").otherwise("negativo"))
    return rows.where(F.col(value).isNotNull()).groupBy("ord", name.alias("indice")).agg(F.sum(value).alias(value))


def stacked(rows: DataFrame, value: str) -> DataFrame:
    """Detailed categories as they are, all others as remainders."""
    own = rows.join(F.broadcast(detailed(rows, value).select("indice")), "indice", "left_semi").select("ord", "indice", value)
    rest = rows.join(F.broadcast(detailed(rows, value).select("indice")), "indice", "left_anti")
    return own.unionByName(remainders(rest, value))


def stack_ends(rows: DataFrame, value: str) -> DataFrame:
    """Per period the heights of the stack above and below zero."""
    return rows.groupBy("ord").agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("arriba"), F.sum(F.least(F.col(value), F.lit(0.0))).alias("abajo"))


def draw_order(index: Column) -> Column:
    """Remainders first, the headline last."""
    return F.when(index.startswith("resto "), 0).when(index == "INPC", 2).otherwise(1)


def points(rows: DataFrame, periodicity: str) -> DataFrame:
    """Rows that carry a point: all if there are few periods, else those that stand alone in their line."""
    few = rows.agg(F.countDistinct("ord").alias("periods")).first().periods <= POINTS[periodicity]
    alone = F.count("*").over(W.partitionBy("indice", "linea") if "linea" in rows.columns else W.partitionBy("indice"))
    return rows if few else rows.withColumn("_n", alone).where("_n = 1").drop("_n")


def combined(result: DataFrame, other: DataFrame | None) -> DataFrame:
    """Result and comparison in one frame, told apart by `linea`."""
    own = result.withColumn("linea", F.lit("resultado"))
    return own if other is None else own.unionByName(other.withColumn("linea", F.lit("comparacion")), allowMissingColumns=True)


def clipped(rows: DataFrame, desde: str | None, hasta: str | None, periodicity: str) -> DataFrame:
    """The rows from `desde` to `hasta`; texts of another periodicity are refused first, then periods that no row has."""
    a, z = (parse_as(x, periodicity) if x else None for x in (desde, hasta))
    consult.check_range(rows, a, z)
    return consult.in_range(rows, a, z)
