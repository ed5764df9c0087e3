"""Tables printed as lines: relations of (documento, linea, texto), from which rows are rebuilt by windows within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: A number at the end of a line closes a row; a number or code at its start opens one.
LAST_NUMBER, FIRST_CODE = r"(-?\d[\d,]*(?:\.\d+)?)\s*$", r"^\s*\d[\d.]*\s"


def _order() -> WindowSpec:
    return W.partitionBy("documento").orderBy("linea")


def carried(lines: DataFrame, heading: Column, name: str = "grupo") -> DataFrame:
    """Adds the last heading at or above each line (null above the first); `heading` is null for lines that are none."""
    return lines.withColumn(name, F.last(heading, ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, W.currentRow)))


def rows_by_number(lines: DataFrame) -> DataFrame:
    """documento, linea (the first), texto, valor: lines joined until one ends with a number; what follows the last number has no valor."""
    number = F.regexp_extract("texto", LAST_NUMBER, 1)
    ends = (number != "").cast("int")
    row = F.coalesce(F.sum(ends).over(_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = F.trim(F.regexp_replace("texto", LAST_NUMBER, ""))
    parts = F.sort_array(F.collect_list(F.struct("linea", text.alias("t"))))
    g = lines.withColumn("_row", row).withColumn("_n", number).groupBy("documento", "_row").agg(F.min("linea").alias("linea"), parts.alias("p"), F.max(F.when(F.col("_n") != "", F.col("_n"))).alias("n"))
    joined = F.trim(F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda x: x != ""), " "))
    return g.select("documento", "linea", joined.alias("texto"), F.regexp_replace("n", ",", "").try_cast("double").alias("valor"))


def with_continuation(lines: DataFrame) -> DataFrame:
    """Lines that open with a code, joined with the next line where that one has none; other lines are left out."""
    opens = F.col("texto").rlike(FIRST_CODE)
    after = F.lead("texto").over(_order())
    more = after.isNotNull() & ~after.rlike(FIRST_CODE)
    return lines.withColumn("_opens", opens).withColumn("texto", F.when(more, F.concat_ws(" ", F.trim("texto"), F.trim(after))).otherwise(F.trim("texto"))).where("_opens").drop("_opens")


def without_totals(lines: DataFrame) -> DataFrame:
    """Without blank lines and lines that begin with a total."""
    return lines.where((F.trim("texto") != "") & ~F.lower(F.trim("texto")).startswith("total"))


def with_annex(items: DataFrame, annex: DataFrame, key: str = "generico") -> DataFrame:
    """The items with an annex's columns; items that it lacks have nulls."""
    return items.join(annex, key, "left")
