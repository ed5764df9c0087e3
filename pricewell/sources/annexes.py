"""Annexes of the manuals as printed lines, each parsed by its own grammar and joined to one basket.

Lines are a relation of documento, anexo (CCIF, COG or SCIAN), linea (their order) and texto. Rows that the layout splits are put together by automata, headings
are carried down by windows within a document; nothing but a document's order is sequential.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ConfigurationProblem
from ..functions.text import normalized, without_number
from ..operators.automata import states
from .baskets import FILE_COLUMNS

#: First and last page of each annex of a version's manual.
PAGES = {
    2010: {"COG": (61, 66), "CCIF": (67, 72)},
    2013: {"CCIF": (61, 71), "SCIAN": (72, 82)},
    2018: {"CCIF": (91, 98), "COG": (99, 107), "SCIAN": (108, 115)},
    2024: {"CCIF": (91, 100), "SCIAN": (101, 109)},
}
#: How lines of the annexes look.
NUMBER = r"-?\d+\.\d+"
CLASS, GROUP, DIVISION = r"^(\d{2}\.\d\.\d)\s+(.+)$", r"^(\d{2}\.\d)\s+(.+)$", r"^(\d{2})\s+(.+)$"
ROW_2010_CCIF = rf"^\s*(\S.*?)\s{{2,}}({NUMBER})\s*$"
ROW_2010_COG = rf"^(\S.*?)\s+({NUMBER})\s*$"
ROW_2013 = rf"^\s*(\S.*?)\s{{2,}}({NUMBER})\s+({NUMBER})\s*$"
NUMBERS_2013 = rf"^\s*({NUMBER})\s+({NUMBER})\s*$"
SECTOR_2013, BRANCH_2013, END_2013 = r"^\d{2}(?:-\d{2})?\.\s+(.+)$", r"^Rama\s+(\d{4})\.\s+(.+)$", "Anexo III"
ROW_2018_CCIF = rf"^\s*(\S.*?)\s{{2,}}(?:(No duradero|Duradero|Semiduradero|Servicio)\s{{2,}})?({NUMBER})\s*$"
ROW_2018 = rf"^\s*(\S.*?)\s{{2,}}{NUMBER}\s*$"
LEVEL_2018_COG, ITEM_2018, SECTOR_2018, BRANCH_2018 = r"^(\d+(?:\.\d+)*)\.\s+(.+)$", r"^\d{3}\s", r"^\d{2}\s", r"^\d{4}\s"
ROW_2024_SCIAN = rf"^(\S.*?)(?:\s+(?:Primario|Secundario|Terciario))?\s+({NUMBER})\s*$"
NUMBER_2024 = rf"^\s*{NUMBER}\s*$"
#: Lines that belong to no row.
NOISE = {
    2013: r"Documento Metodológico INPC|^\s*Anexo [IVX]+\s*$|Ponderadores y Factor de Encadenamiento|Clasificación del Consumo Individual por Finalidades|Clasificación SCIAN|Concepto\s+Ponderación|La suma de ponderadores puede no ser|^\s*\d{1,4}\s*$",
    2018: r"Canasta del INPC clasificada|INEGI\. Índice Nacional de Precios|Nota: La suma de los parciales|Total general|\(Continúa\)|^\s*Anexo [A-Z]\.|^\s*julio de 2018\s*$|^\s*\d{1,3}\s*$",
    2024: r"Canasta del INPC clasificada|INEGI\. Índice Nacional de Precios|Total general|\(Continúa\)|^[A-Z]\.\s|relativos a la segunda quincena|Nota:|^\s*\d{1,3}\s*$",
}
#: Rows that are totals.
TOTALS_2010 = ("total", "inpc")
TOTALS_2013 = ("inpc", "indice general", "sector economico primario", "sector economico secundario", "sector economico terciario")
#: Categories of the COG annex of 2010, and words that its layout breaks.
COG_2010 = (
    "alimentos bebidas y tabaco",
    "ropa calzado y accesorios",
    "vivienda",
    "muebles aparatos y accesorios domesticos",
    "salud y cuidado personal",
    "transporte",
    "educacion y esparcimiento",
    "otros servicios",
)
BROKEN_2010 = (("otroschilesfrescos", "otros chiles frescos"), ("otrosm ariscos", "otros mariscos"), ("otrosse rvicios", "otros servicios"))
BROKEN_2024 = (("comesti bles", "comestibles"), ("interna cionales", "internacionales"))

#: Lines of a row: 0 name and numbers, 1 numbers alone, 2 text. Of 2013, states: 0 no row begun, 1 a name begun, 2 a name and its numbers, which more text closes.
SPLIT_2013 = ((0, 1, 1), (2, 2, 0), (2, 0, 0))
#: Of 2024: 0 no row begun, 1 a name begun, which a number closes.
SPLIT_2024 = ((0, 1, 1), (0, 0, 1))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """documento (the file), pagina, linea, texto of text files whose pages a form feed parts; linea counts through the document's pages."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("documento"), F.split("value", "\f").alias("p"))
    pages = files.select("documento", F.posexplode("p").alias("n", "body"))
    lines = pages.select("documento", (F.col("n") + 1).alias("pagina"), F.posexplode(F.split("body", "\r?\n")).alias("k", "texto"))
    return lines.select("documento", "pagina", F.struct("pagina", "k").alias("linea"), "texto")


def by_page(lines: DataFrame, version: int) -> DataFrame:
    """Adds anexo by the pages that a version's manual has it on; other pages are left out."""
    at = F.lit(None).cast("string")
    for name, (first, last) in PAGES[version].items():
        at = F.when(F.col("pagina").between(first, last), name).otherwise(at)
    return lines.withColumn("anexo", at).where("anexo is not null")


def by_heading(lines: DataFrame, headings: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds anexo by the last heading (annex, pattern) at or above a line; lines above the first one are left out."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(headings):
        found = F.when(F.col("texto").rlike(pattern), name).otherwise(found)
    down = W.partitionBy("documento").orderBy("linea").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("anexo", F.last(found, ignorenulls=True).over(down)).where("anexo is not null")


def _down(value: Column) -> Column:
    """The last value that is not null at or above a row of its document; empty above the first."""
    return F.coalesce(F.last(value, ignorenulls=True).over(W.partitionBy("documento").orderBy("linea").rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(""))


def _matched(lines: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """The lines that fit a pattern, with its groups as columns."""
    return lines.where(F.col("texto").rlike(pattern)).select("documento", "linea", *(F.regexp_extract("texto", pattern, k).alias(c) for c, k in groups.items()))


def _item(name: Column | str = "nombre") -> Column:
    return without_number(normalized(F.col(name) if isinstance(name, str) else name))


def _replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def by_levels(rows: DataFrame, *values: str) -> DataFrame:
    """documento, generico, values and the three levels of CCIF of rows (documento, linea, nombre): a heading ends those below it."""
    name = F.col("nombre")
    coded = lambda p: F.when(name.rlike(p), F.concat(F.regexp_extract(name, p, 1), F.lit(" "), normalized(F.regexp_extract(name, p, 2))))
    own = rows.withColumns({"_d": coded(DIVISION), "_g": coded(GROUP), "_c": coded(CLASS)})
    empty = F.lit("")
    out = own.withColumns({
        "CCIF division": _down(F.col("_d")),
        "CCIF grupo": _down(F.when(F.col("_g").isNotNull(), F.col("_g")).when(F.col("_d").isNotNull(), empty)),
        "CCIF clase": _down(F.when(F.col("_c").isNotNull(), F.col("_c")).when(F.col("_g").isNotNull() | F.col("_d").isNotNull(), empty)),
    })
    return out.where("_d is null and _g is null and _c is null").select("documento", _item().alias("generico"), *values, "`CCIF division`", "`CCIF grupo`", "`CCIF clase`")


def split_rows(lines: DataFrame, row: str, numbers: str, table: Sequence[Sequence[int]]) -> DataFrame:
    """documento, linea, nombre, n1, n2 of rows that stand on one line or on several, whichever of these have the numbers; noise and blank lines are out before.

    A row begins where the automaton is in state 0 and ends where it is there again; what has no end, or no numbers, is no row.
    """
    text = F.col("texto")
    token = F.when(text.rlike(row), 0).when(text.rlike(numbers), 1).otherwise(2)
    two = row == ROW_2013
    run = states(lines.where(F.trim(text) != "").select("documento", "linea", "texto", token.alias("clase")), F.col("clase"), table)
    kind, begun = F.col("clase"), F.col("antes") == 1
    bare = (kind == 1) & begun  # numbers that belong to a name begun; else they are text like any
    part = F.when(kind == 0, F.regexp_extract(text, row, 1)).when(~bare, F.trim(text))
    first = F.when(kind == 0, F.regexp_extract(text, row, 2)).when(bare, F.regexp_extract(text, rf"^\s*({NUMBER})", 1))
    second = F.when(kind == 0, F.regexp_extract(text, row, 3)).when(bare, F.regexp_extract(text, numbers, 2)) if two else F.lit(None).cast("string")
    before = W.partitionBy("documento").orderBy("linea").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = run.withColumn("_row", F.sum((F.col("antes") == 0).cast("int")).over(before))
    g = marked.groupBy("documento", "_row").agg(
        F.min("linea").alias("linea"), F.sort_array(F.collect_list(F.when(part.isNotNull(), F.struct("linea", part.alias("t"))))).alias("p"),
        F.max_by("despues", "linea").alias("end"), F.max(F.when(first.isNotNull(), F.struct("linea", first.alias("n1"), second.alias("n2")))).alias("n"),
    )
    return g.where("end = 0 and n is not null").select("documento", "linea", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("nombre"), "n.n1", "n.n2")


def _without(lines: DataFrame, version: int) -> DataFrame:
    return lines.where(~F.col("texto").rlike(NOISE[version]))


def _ccif_2010(lines: DataFrame) -> DataFrame:
    rows = _matched(lines, ROW_2010_CCIF, nombre=1, ponderador=2).where(~normalized(F.col("nombre")).isin(*TOTALS_2010))
    return by_levels(rows, "ponderador")


def _cog_2010(lines: DataFrame) -> DataFrame:
    name = normalized(F.col("nombre"))
    for a, b in BROKEN_2010:
        name = F.when(name == a, b).otherwise(name)
    rows = _matched(lines, ROW_2010_COG, nombre=1).withColumn("nombre", name).where(~F.col("nombre").isin(*TOTALS_2010))
    heading = F.col("nombre").isin(*COG_2010)
    return rows.withColumn("COG", _down(F.when(heading, F.col("nombre")))).where(~heading).select("documento", without_number(F.col("nombre")).alias("generico"), "COG")


def _rows_2013(lines: DataFrame) -> DataFrame:
    rows = split_rows(_without(lines, 2013), ROW_2013, NUMBERS_2013, SPLIT_2013)
    return rows.withColumnsRenamed({"n1": "ponderador", "n2": "encadenamiento"})


def _ccif_2013(lines: DataFrame) -> DataFrame:
    return by_levels(_rows_2013(lines).where(~normalized(F.col("nombre")).isin(*TOTALS_2013)), "ponderador", "encadenamiento")


def _scian_2013(lines: DataFrame) -> DataFrame:
    """A sector's code is that of the branch, as its own heading may hold two."""
    before = W.partitionBy("documento").orderBy("linea").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = _rows_2013(lines).withColumn("_over", F.bool_or(F.trim("nombre") == END_2013).over(before)).where("not _over")
    name = F.col("nombre")
    branch, sector = name.rlike(BRANCH_2013), name.rlike(SECTOR_2013)
    own = rows.where(~normalized(name).isin(*TOTALS_2013)).withColumns({
        "_r": _down(F.when(branch, F.regexp_extract(name, BRANCH_2013, 1))), "_b": _down(F.when(branch, F.regexp_extract(name, BRANCH_2013, 2))),
        "_s": _down(F.when(sector & ~branch, F.regexp_extract(name, SECTOR_2013, 1))),
    })
    return own.where(~branch & ~sector).select("documento", _item().alias("generico"), F.concat(F.substring("_r", 1, 2), F.lit(" "), normalized(F.col("_s"))).alias("SCIAN sector"), F.concat("_r", F.lit(" "), normalized(F.col("_b"))).alias("SCIAN rama"))


def _ccif_2018(lines: DataFrame) -> DataFrame:
    rows = _matched(_without(lines, 2018), ROW_2018_CCIF, nombre=1, durabilidad=2, ponderador=3)
    return by_levels(rows.withColumn("durabilidad", normalized(F.col("durabilidad"))), "ponderador", "durabilidad")


def _cog_2018(lines: DataFrame) -> DataFrame:
    rows = _matched(_without(lines, 2018), ROW_2018, nombre=1)
    name = F.col("nombre")
    level = name.rlike(LEVEL_2018_COG)
    top = level & ~F.regexp_extract(name, LEVEL_2018_COG, 1).contains(".")
    own = rows.withColumn("COG", _down(F.when(top, normalized(F.regexp_extract(name, LEVEL_2018_COG, 2)))))
    return own.where(~level & name.rlike(ITEM_2018)).select("documento", _item().alias("generico"), "COG")


def _coded_scian(rows: DataFrame) -> DataFrame:
    """Sectors have codes of two digits, branches of four, items of three."""
    name = F.col("nombre")
    code, rest = F.substring_index(name, " ", 1), F.expr("substr(nombre, instr(nombre, ' ') + 1)")
    branch, sector = name.rlike(BRANCH_2018), name.rlike(SECTOR_2018)
    stated = F.concat(code, F.lit(" "), normalized(rest))
    own = rows.withColumns({"SCIAN sector": _down(F.when(sector, stated)), "SCIAN rama": _down(F.when(branch, stated))})
    blank = lambda c: F.when(F.col(c) == "", " ").otherwise(F.col(c)).alias(c)
    return own.where(name.rlike(ITEM_2018)).select("documento", _item().alias("generico"), blank("SCIAN sector"), blank("SCIAN rama"))


def _scian_2018(lines: DataFrame) -> DataFrame:
    """A heading goes on in the next line if that is no row, no noise and not blank; its number stands in the first."""
    after = F.trim(F.lead("texto").over(W.partitionBy("documento").orderBy("linea")))
    joins = after.isNotNull() & (after != "") & ~after.rlike(NOISE[2018]) & ~after.rlike(ROW_2018)
    seen = _without(lines.withColumn("_after", F.when(joins, after)), 2018).where(F.col("texto").rlike(ROW_2018))
    name = F.regexp_extract("texto", ROW_2018, 1)
    heading = name.rlike(BRANCH_2018) | name.rlike(SECTOR_2018)
    return _coded_scian(seen.select("documento", "linea", F.when(heading & F.col("_after").isNotNull(), F.concat(name, F.lit(" "), "_after")).otherwise(name).alias("nombre")))


def _scian_2024(lines: DataFrame) -> DataFrame:
    rows = split_rows(_without(lines, 2024), ROW_2024_SCIAN, NUMBER_2024, SPLIT_2024)
    return _coded_scian(rows.withColumn("nombre", _replaced(F.col("nombre"), BROKEN_2024)))


GRAMMARS = {
    2010: {"CCIF": _ccif_2010, "COG": _cog_2010},
    2013: {"CCIF": _ccif_2013, "SCIAN": _scian_2013},
    2018: {"CCIF": _ccif_2018, "COG": _cog_2018, "SCIAN": _scian_2018},
    2024: {"CCIF": _ccif_2018, "SCIAN": _scian_2024},
}


def basket_of(lines: DataFrame, version: int) -> DataFrame:
    """documento and the fifteen columns of a basket file, of the lines (documento, anexo, linea, texto) of a version's manuals.

    The CCIF annex has the items; those that another annex lacks have empty texts there, and columns that no annex has are empty.
    """
    if version not in GRAMMARS:
        raise ConfigurationProblem(f"no annexes of version {version}")
    parts = {name: parse(lines.where(F.col("anexo") == name)) for name, parse in GRAMMARS[version].items()}
    out = parts.pop("CCIF")
    for annex in parts.values():
        out = out.join(annex, ["documento", "generico"], "left")
    return out.select("documento", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in out.columns else F.lit("").alias(c) for c in FILE_COLUMNS))
