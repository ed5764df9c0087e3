"""Basket CSV files, in and out."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CLASSES, CORE_CLASSES, HEADLINE
from ..errors import ColumnsMissing, InvariantBroken
from ..functions.text import normalized

NUMBERS = ("ponderador", "encadenamiento")
#: The columns of a basket file, in order.
FILE_COLUMNS = ("generico", *NUMBERS, "COG", "CCIF division", "CCIF grupo", "CCIF clase", "inflacion componente", "inflacion subcomponente", "inflacion agrupacion", "SCIAN sector", "SCIAN rama", "durabilidad", "canasta basica", "canasta consumo minimo")


def read_basket(spark: SparkSession, path: str, version: int) -> DataFrame:
    """version, generico, ponderador, encadenamiento (numbers, and as text in *_txt) and the classification columns in upper case."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    lacking = [c for c in FILE_COLUMNS if c not in raw.columns]
    if lacking:
        raise ColumnsMissing(f"{path} lacks {lacking}")
    names = {c: c.upper() for c in FILE_COLUMNS if c.upper() in CLASSES}
    out = raw.select(
        F.lit(version).alias("version"),
        normalized(F.col("generico")).alias("generico"),
        *(x for c in NUMBERS for x in (F.col(c).try_cast("double").alias(c), F.col(c).alias(f"{c}_txt"))),
        *(F.col(c).alias(u) for c, u in names.items()),
    )
    core = F.lit(False)
    for c in CORE_CLASSES:
        core = core | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == "")
    bad = out.where(core).limit(1).collect()
    if bad:
        raise InvariantBroken(f"{bad[0].generico!r} lacks one of {CORE_CLASSES}")
    return out


def classes_of(basket: DataFrame) -> DataFrame:
    """version, generico, tipo, categoria: one row a classification, the headline among them."""
    kinds = F.explode(F.create_map(F.lit(HEADLINE), F.lit(HEADLINE), *(x for c in CLASSES for x in (F.lit(c), F.col(f"`{c}`"))))).alias("tipo", "categoria")
    return basket.select("version", "generico", kinds).where("categoria is not null")


def summary(basket: DataFrame) -> DataFrame:
    """Items and distinct categories of each classification."""
    return classes_of(basket).groupBy("version", "tipo").agg(F.count("*").alias("genericos"), F.countDistinct("categoria").alias("categorias"))


def write_basket(basket: DataFrame, path: str) -> None:
    """A folder with one CSV file of FILE_COLUMNS; other columns are left out with a warning, lacking ones are empty."""
    extra = sorted(set(basket.columns) - set(FILE_COLUMNS))
    if extra:
        warnings.warn(f"not written: {extra}", stacklevel=2)
    cols = [(F.col(f"`{c}`").cast("string") if c in basket.columns else F.lit(None).cast("string")) for c in FILE_COLUMNS]
    out = basket.select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cols, FILE_COLUMNS, strict=True)))
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)  # a basket has some hundred rows


def write_audit(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)
