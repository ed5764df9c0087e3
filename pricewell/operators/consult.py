"""Queries over variations and incidences: points, ranges, extremes and wide views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvariantBroken, PeriodUnavailable
from ..functions.periods import PER_YEAR, text_column


def at(rows: DataFrame, value: str, ord_: int) -> DataFrame:
    return rows.where(F.col("ord") == ord_).select("tipo", "indice", value)


def in_range(rows: DataFrame, start: int | None = None, end: int | None = None, index: str | None = None) -> DataFrame:
    """Open ends are each category's own first and last period."""
    if start is not None and end is not None and end < start:
        raise InvariantBroken("the end precedes the start")
    out = rows if index is None else rows.where(F.col("indice") == index)
    out = out if start is None else out.where(F.col("ord") >= start)
    return out if end is None else out.where(F.col("ord") <= end)


def check_range(rows: DataFrame, start: int | None = None, end: int | None = None, index: str | None = None) -> None:
    """Raises if an end is a period that no category has, the index is unknown, or nothing lies in the range."""
    for o in (start, end):
        if o is not None and not rows.where(F.col("ord") == o).limit(1).count():
            raise PeriodUnavailable(f"no category has period {o}")
    if index is not None and not rows.where(F.col("indice") == index).limit(1).count():
        raise InvariantBroken(f"there is no index {index!r}")
    if not in_range(rows, start, end, index).limit(1).count():
        raise InvariantBroken("nothing lies in the range")


def total(rows: DataFrame, value: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The plain sum of points, not compounded."""
    return in_range(rows, start, end).groupBy("tipo", "indice").agg(F.sum(value).alias("acumulada"))


def mean(rows: DataFrame, value: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return in_range(rows, start, end).groupBy("tipo", "indice").agg(F.avg(value).alias("promedio"))


def annual_rate(rows: DataFrame, periodicity: str, start: int | None = None, end: int | None = None, value: str = "variacion_pp") -> DataFrame:
    """Compound annual growth in percent: the product of (1 + v / 100) to the power of periods a year over periods."""
    g = in_range(rows, start, end).groupBy("tipo", "indice").agg(F.product(1 + F.col(value) / 100).alias("p"), F.count(value).alias("n"))
    return g.select("tipo", "indice", ((F.pow("p", F.lit(float(PER_YEAR[periodicity])) / F.col("n")) - 1) * 100).alias("tcac"))


def extreme(rows: DataFrame, value: str, greatest: bool, start: int | None = None, end: int | None = None, index: str | None = None) -> DataFrame:
    """The row of the greatest or least value; the earliest period, then the first name, of equals."""
    key = F.desc(value) if greatest else F.asc(value)
    return in_range(rows, start, end, index).where(F.col(value).isNotNull()).orderBy(key, "ord", "indice").limit(1).select("tipo", "ord", "indice", value)


def wide(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a category (and metric, if several), one column a period, in order."""
    long = rows.select("tipo", "indice", "ord", "periodicidad", F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metrica", "valor"))
    periods = [r.p for r in long.select("ord", text_column(F.col("ord"), F.col("periodicidad")).alias("p")).distinct().orderBy("ord").collect()]  # the columns themselves
    keys = ["tipo", "indice", *(["metrica"] if len(metrics) > 1 else [])]
    return long.withColumn("p", text_column(F.col("ord"), F.col("periodicidad"))).groupBy(*keys).pivot("p", periods).agg(F.first("valor"))
