"""Index inputs from order lines: unit prices of named parts by half month stand in for item series, revenue for weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CLASSES, VERSIONS
from ..functions.periods import half_of_date, parse_as
from ..operators import convert, incidence, laspeyres
from ..scratch import written

#: Four versions; link periods belong to both neighbours. Blocks A and B are series with their own base period.
ERAS = ((1, 47880, 47929, "directo", "A"), (2, 47929, 47965, "t1", "A"), (3, 47965, 48005, "directo", "B"), (4, 48005, None, "t2", "B"))
MOVED_ITEM, RENAMED_CLASS, NEW_NAME = "blue", "anvil", "yunque"


@dataclass
class Inputs:
    series: DataFrame
    basket: DataFrame
    classes: DataFrame
    ranges: DataFrame
    renames: DataFrame


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([e[:4] for e in ERAS], "version int, ini int, fin int, metodo string")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """generico, ord, precio, ingreso: one aggregation of the order lines joined to their parts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("generico"))
    both = lines.join(parts, "l_partkey").withColumn("ord", half_of_date(F.col("l_shipdate")).cast("int"))
    return both.groupBy("generico", "ord").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("precio"), F.sum("l_extendedprice").alias("ingreso"))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    cells = written(panel(spark, sf_dir), "panel")  # items by periods: all that is read more than once
    eras = spark.createDataFrame(ERAS, "version int, ini int, fin int, metodo string, bloque string")
    starts = {"A": ERAS[0][1], "B": ERAS[2][1]}
    base = F.when(F.col("bloque") == "A", starts["A"]).otherwise(starts["B"])
    by_era = cells.join(F.broadcast(eras), (F.col("ord") >= F.col("ini")) & (F.col("fin").isNull() | (F.col("ord") <= F.col("fin"))))
    first = cells.join(F.broadcast(eras.select("bloque").distinct()), F.col("ord") >= base).groupBy("bloque", "generico").agg(F.min_by("precio", "ord").alias("precio_base"))
    series = by_era.join(first, ["bloque", "generico"]).select("version", "generico", "ord", (F.col("precio") / F.col("precio_base") * 100).alias("valor"))
    spent = by_era.groupBy("version", "generico").agg(F.sum("ingreso").alias("ingreso"))
    total = spent.groupBy("version").agg(F.sum("ingreso").alias("total"))
    weights = written(spent.join(F.broadcast(total), "version").select("version", "generico", (F.col("ingreso") * 100 / F.col("total")).alias("ponderador")), "weights")
    # T1 publishes factors; here they are the series at the link period, off by a constant of the item.
    at_link = laspeyres.fill(laspeyres.grid(laspeyres.trim(series, ranges(spark)), weights)).where(f"version = 2 and ord = {ERAS[1][1]}")
    factor = at_link.select("version", "generico", (F.col("valor") / 100 * (1 + (F.length("generico") % 5 - 2) / 100.0)).alias("encadenamiento"))
    basket = weights.join(factor, ["version", "generico"], "left")
    words = F.split("generico", " ")
    adjective, noun = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    moved = F.when((F.col("version") == 4) & (adjective == MOVED_ITEM) & (noun == RENAMED_CLASS), F.lit("otro")).otherwise(adjective)
    new = F.when((F.col("version") == 4) & (noun == RENAMED_CLASS), F.lit(NEW_NAME)).otherwise(noun)
    classes = weights.select("version", "generico", F.explode(F.create_map(F.lit("INPC"), F.lit("INPC"), F.lit("SUSTANTIVO"), noun, F.lit("ADJETIVO"), moved, F.lit("RENOMBRE"), new)).alias("tipo", "categoria"))
    renames = spark.createDataFrame([(4, "RENOMBRE", NEW_NAME, RENAMED_CLASS)], "version int, tipo string, indice string, nuevo string")
    return Inputs(written(series, "series"), written(basket, "basket"), written(classes, "classes"), ranges(spark), renames)


def raw(x: Inputs) -> DataFrame:
    return laspeyres.raw_index(x.series, x.basket, x.classes, x.ranges)


def history(x: Inputs, ord_ref: int | None = None) -> DataFrame:
    """All versions and classifications linked, spliced and rebased at the first period of version 3."""
    linked = convert.linked_history(raw(x), x.ranges, x.renames)
    return convert.rebase(convert.splice(linked), ERAS[2][1] if ord_ref is None else ord_ref, check=False)


def category_weights(x: Inputs) -> DataFrame:
    return incidence.weights(x.basket, x.classes, x.renames)


def steady(x: Inputs) -> DataFrame:
    return incidence.stable(x.classes, x.renames)


#: The order lines of 1995 on as half months of the last two versions of the catalogue: 1Q Ene 1995 is 2Q Jul 2018.
SHIFT = 565
#: An item that the later version names anew and puts into another class of DURABILIDAD.
RENAMED_ITEM, ITEM_2018, ITEM_2024 = "blue anvil", "leche de soya", "leches de origen vegetal"
#: Divisions as the two versions' baskets name them.
DIVISIONS = (
    ("01 alimentos y bebidas no alcoholicas", "01 alimentos y bebidas no alcoholicas"),
    ("02 bebidas alcoholicas y tabaco", "02 bebidas alcoholicas y tabaco"),
    ("03 prendas de vestir y calzado", "03 ropa y calzado"),
    ("04 vivienda agua electricidad gas y otros combustibles", "04 vivienda agua electricidad y gas"),
    ("05 muebles articulos para el hogar y para su conservacion", "05 mobiliario equipo domestico y mantenimiento rutinario del hogar"),
    ("06 salud", "06 salud"),
    ("07 transporte", "07 transporte"),
    ("08 comunicaciones", "08 informacion y comunicacion"),
    ("09 recreacion y cultura", "09 recreacion deporte y cultura"),
    ("10 educacion", "10 servicios educativos"),
    ("11 restaurantes y hoteles", "11 restaurantes y servicios de alojamiento"),
    ("12 bienes y servicios diversos", "13 cuidado personal proteccion social y bienes diversos"),
)


def versioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """canastas and series as the verbs take them: versions 2018 and 2024, all classification columns, native names in each version."""
    ini = {v: parse_as(a, "Q") for v, a, *_ in VERSIONS}
    cells = written(panel(spark, sf_dir).withColumn("ord", F.col("ord") + SHIFT).withColumnRenamed("generico", "parte"), "panel")
    later = F.col("version") == 2024
    eras = spark.createDataFrame([(2018, ini[2018], ini[2024]), (2024, ini[2024], None)], "version int, ini int, fin int")
    by_era = cells.join(F.broadcast(eras), (F.col("ord") >= F.col("ini")) & (F.col("fin").isNull() | (F.col("ord") <= F.col("fin"))))
    first = cells.groupBy("parte").agg(F.min_by("precio", "ord").alias("precio_base"))
    named = F.when(F.col("parte") == RENAMED_ITEM, F.when(later, ITEM_2024).otherwise(ITEM_2018)).otherwise(F.col("parte"))
    series = by_era.join(first, "parte").select("version", named.alias("generico"), "ord", (F.col("precio") / F.col("precio_base") * 100).alias("valor"))
    spent = by_era.groupBy("version", "parte").agg(F.sum("ingreso").alias("ingreso"))
    total = spent.groupBy("version").agg(F.sum("ingreso").alias("total"))
    k = (F.ascii("parte") * 3 + F.ascii(F.element_at(F.split("parte", " "), 2)) + F.length("parte")) % len(DIVISIONS)
    names = [F.element_at(F.array(*(F.lit(d[i]) for d in DIVISIONS)), k + 1) for i in (0, 1)]
    core = F.when(k < 7, "subyacente").otherwise("no subyacente")
    lasting = F.when(later & (F.col("parte") == RENAMED_ITEM), "servicios").when(k % 3 == 0, "duraderos").when(k % 3 == 1, "servicios").otherwise("no duraderos")
    own = {"INFLACION COMPONENTE": core, "CCIF DIVISION": F.when(later, names[1]).otherwise(names[0]), "DURABILIDAD": lasting}
    basket = spent.join(F.broadcast(total), "version").select(
        "version", named.alias("generico"), (F.col("ingreso") * 100 / F.col("total")).alias("ponderador"), F.lit(None).cast("double").alias("encadenamiento"),
        *(own.get(c, F.lit(None).cast("string")).alias(c) for c in CLASSES),
    )
    return written(basket, "baskets"), written(series, "series")
