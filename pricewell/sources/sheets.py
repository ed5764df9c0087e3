"""Sheets of the published workbooks as cells, walked row by row: groups carried down, totals left out, marks turned into classes.

Cells are a relation of documento, hoja, fila, columna (from 1), texto (as the file has it) and numerico (whether the cell is a number).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ConfigurationProblem
from ..functions.text import normalized, without_number
from .baskets import FILE_COLUMNS

#: First texts of rows that are totals.
TOTALS = ("indice general", "total", "suma", "factor de encadenamiento")
MARK = "X"


@dataclass(frozen=True)
class Layout:
    """Where a version's workbook has what. Without `grupo`, groups stand in the items' column, in rows without any mark."""

    hoja_cog: str
    hoja_ccif: str | None
    generico: int
    grupo: int | None
    ponderador: int
    encadenamiento: int | None
    canasta_basica: int
    consumo_minimo: int | None
    marcas: dict[int, tuple[str, str, str]]


#: Sheets and columns by version; of a marked column the component, subcomponent and group that it stands for.
LAYOUTS = {
    2010: Layout(
        hoja_cog="Ponderadores INPC INEGI",
        hoja_ccif=None,
        generico=2,
        grupo=1,
        ponderador=3,
        encadenamiento=None,
        canasta_basica=19,
        consumo_minimo=None,
        marcas={
            6: ("subyacente", "mercancias", "alimentos bebidas y tabaco"),
            7: ("subyacente", "mercancias", "mercancias no alimenticias"),
            9: ("subyacente", "servicios", "vivienda"),
            10: ("subyacente", "servicios", "otros servicios"),
            11: ("subyacente", "servicios", "educacion"),
            14: ("no subyacente", "agropecuarios", "frutas y verduras"),
            15: ("no subyacente", "agropecuarios", "pecuarios"),
            17: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "energeticos"),
            18: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "tarifas autorizadas por el gobierno"),
        },
    ),
    2013: Layout(
        hoja_cog="Ponderadores INPC INEGI",
        hoja_ccif="Ponderadores INPC COICOP INEGI",
        generico=2,
        grupo=1,
        ponderador=3,
        encadenamiento=4,
        canasta_basica=20,
        consumo_minimo=None,
        marcas={
            7: ("subyacente", "mercancias", "alimentos bebidas y tabaco"),
            8: ("subyacente", "mercancias", "mercancias no alimenticias"),
            10: ("subyacente", "servicios", "vivienda"),
            11: ("subyacente", "servicios", "otros servicios"),
            12: ("subyacente", "servicios", "educacion"),
            15: ("no subyacente", "agropecuarios", "frutas y verduras"),
            16: ("no subyacente", "agropecuarios", "pecuarios"),
            18: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "energeticos"),
            19: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "tarifas autorizadas por el gobierno"),
        },
    ),
    2018: Layout(
        hoja_cog="Objeto de gasto",
        hoja_ccif="CCIF",
        generico=1,
        grupo=None,
        ponderador=2,
        encadenamiento=None,
        canasta_basica=19,
        consumo_minimo=None,
        marcas={
            5: ("subyacente", "mercancias", "alimentos bebidas y tabaco"),
            6: ("subyacente", "mercancias", "mercancias no alimenticias"),
            8: ("subyacente", "servicios", "educacion colegiaturas"),
            9: ("subyacente", "servicios", "vivienda"),
            10: ("subyacente", "servicios", "otros servicios"),
            13: ("no subyacente", "agropecuarios", "frutas y verduras"),
            14: ("no subyacente", "agropecuarios", "pecuarios"),
            16: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "energeticos"),
            17: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "tarifas autorizadas por el gobierno"),
        },
    ),
    2024: Layout(
        hoja_cog="Objeto de gasto",
        hoja_ccif="CCIF",
        generico=1,
        grupo=None,
        ponderador=2,
        encadenamiento=3,
        canasta_basica=20,
        consumo_minimo=21,
        marcas={
            6: ("subyacente", "mercancias", "alimentos bebidas y tabaco"),
            7: ("subyacente", "mercancias", "mercancias no alimenticias"),
            9: ("subyacente", "servicios", "educacion colegiaturas"),
            10: ("subyacente", "servicios", "vivienda"),
            11: ("subyacente", "servicios", "otros servicios"),
            14: ("no subyacente", "agropecuarios", "frutas y verduras"),
            15: ("no subyacente", "agropecuarios", "pecuarios"),
            17: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "energeticos"),
            18: ("no subyacente", "energeticos y tarifas autorizadas por el gobierno", "tarifas autorizadas por el gobierno"),
        },
    ),
}


def walk(cells: DataFrame, layout: Layout) -> DataFrame:
    """documento, fila, generico, _grupo and what the row's other cells say, of the items of one sheet; rows without a number as weight are none.

    One aggregation brings the needed cells of a row together, one window carries the groups down a document.
    """
    used = {layout.generico, layout.ponderador, layout.canasta_basica, *layout.marcas, *(c for c in (layout.grupo, layout.encadenamiento, layout.consumo_minimo) if c)}
    cell = lambda c: F.max(F.when(F.col("columna") == c, F.col("texto"))).alias(f"_{c}")
    weighed = F.bool_or((F.col("columna") == layout.ponderador) & F.col("numerico")).alias("_weighed")
    rows = cells.where(F.col("columna").isin(*sorted(used))).groupBy("documento", "fila").agg(*(cell(c) for c in sorted(used)), weighed).where("_weighed")
    text = lambda c: F.trim(F.coalesce(F.col(f"_{c}"), F.lit("")))
    total = lambda c: F.lower(text(c)).isin(*TOTALS)
    marked = lambda c: F.coalesce(F.col(f"_{c}") == MARK, F.lit(False))
    item = text(layout.generico)
    if layout.grupo is None:
        any_mark = F.lit(False)
        for c in layout.marcas:
            any_mark = any_mark | marked(c)
        named = (item != "") & ~total(layout.generico)
        heading, is_item, title = named & ~any_mark, named & any_mark, item
    else:
        title = text(layout.grupo)
        heading = (title != "") & (item == "") & ~total(layout.grupo)
        is_item = (item != "") & ~total(layout.generico)
    down = W.partitionBy("documento").orderBy("fila").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_grupo", F.coalesce(F.last(F.when(heading, normalized(title)), ignorenulls=True).over(down), F.lit(""))).where(is_item)

    def kind(k: int) -> Column:
        out = F.lit("")
        for c, names in reversed(list(layout.marcas.items())):  # the first marked column counts
            out = F.when(marked(c), names[k]).otherwise(out)
        return out

    yes = lambda c: F.when(marked(c), MARK).otherwise("-") if c else F.lit("")
    raw = lambda c: F.coalesce(F.col(f"_{c}"), F.lit("")) if c else F.lit("")
    return rows.select(
        "documento", "fila", normalized(item).alias("generico"), raw(layout.ponderador).alias("ponderador"), raw(layout.encadenamiento).alias("encadenamiento"), "_grupo",
        kind(0).alias("inflacion componente"), kind(1).alias("inflacion subcomponente"), kind(2).alias("inflacion agrupacion"),
        yes(layout.canasta_basica).alias("canasta basica"), yes(layout.consumo_minimo).alias("canasta consumo minimo"),
    )


def basket_of(cells: DataFrame, version: int) -> DataFrame:
    """documento and the fifteen columns of a basket file, of the cells of a version's workbooks; what workbooks don't have is empty.

    Of an item that the second sheet has twice, the last row counts.
    """
    if version not in LAYOUTS:
        raise ConfigurationProblem(f"no workbook of version {version}")
    layout = LAYOUTS[version]
    out = walk(cells.where(F.col("hoja") == layout.hoja_cog), layout)
    if layout.hoja_ccif:
        other = walk(cells.where(F.col("hoja") == layout.hoja_ccif), layout).groupBy("documento", "generico").agg(F.max_by("_grupo", "fila").alias("_ccif"))
        out = out.join(other, ["documento", "generico"], "left")
    own = {"COG": without_number(F.col("_grupo")), "generico": without_number(F.col("generico"))}
    own["CCIF division"] = without_number(F.coalesce("_ccif", F.lit(""))) if layout.hoja_ccif else F.lit("")
    return out.select("documento", *(own.get(c, F.col(f"`{c}`") if c in out.columns else F.lit("")).alias(c) for c in FILE_COLUMNS))
