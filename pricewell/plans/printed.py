"""Manuals and workbooks made of parts, as printed lines and as cells: inputs of the registered queries that parse them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.annexes import COG_2010, PAGES
from ..sources.sheets import LAYOUTS

DURABILITIES = ("No duradero", "Duradero", "Semiduradero", "Servicio")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _code(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def lines(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """documento, pagina, anexo (what a reader has to find out), linea, texto of four manuals: a part is an item, and some parts open headings above it."""
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_retailprice"), F.col("p_partkey")
    opens = {"d": key % 24 < 4, "g": key % 12 < 4, "c": key % 8 < 4}
    w, factor = F.format_string("%.2f", "p_retailprice"), F.format_string("%d.5", key % 7)
    numbers = _text(w, "    ", factor) if version == 2013 else w
    code, name = _code(key % 1000, 3), _text(F.col("p_name"), " ", key, " pieza")
    div, title = _code(key % 90 + 10, 2), F.col("p_type")
    grp, cls = _text(div, ".", key % 9 + 1), _text(div, ".", key % 9 + 1, ".", key % 7 + 1)
    gap = "     "
    row = lambda *x: _text("  ", *x, gap, numbers)
    made: list[tuple[str, int, Column | None, Column]] = [("CCIF", 0, opens["d"], row(div, " ", title)), ("CCIF", 1, opens["g"], row(grp, " Grupo ", title)), ("CCIF", 2, opens["c"], row(cls, " Clase, ", title))]
    adjective, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    split = lambda annex, k, some: [
        (annex, k, some & (key % 3 == 0), row(code, " ", name)),
        (annex, k, some & (key % 3 == 1), _text(" ", code, " ", adjective)), (annex, k + 1, some & (key % 3 == 1), _text("        ", numbers)),
        (annex, k + 2, some & (key % 6 == 1), _text("   ", key % 90 + 10)), (annex, k + 3, some & (key % 6 == 1), F.lit("Documento Metodológico INPC")), (annex, k + 4, some & (key % 3 == 1), _text("  ", noun, " ", key, " pieza")),
        (annex, k, some & (key % 3 == 2), _text(" ", code, " ", adjective)), (annex, k + 1, some & (key % 3 == 2), _text("  ", noun, " ", key, gap, numbers)), (annex, k + 2, some & (key % 3 == 2), F.lit("  pieza")),
    ]
    has_cog, has_scian = key % 5 != 0, key % 5 != 1
    if version == 2010:
        category = F.element_at(F.array(*(F.lit(x) for x in (*COG_2010[:-1], "otrosse rvicios"))), (key % 8 + 1).cast("int"))
        made += [("CCIF", 5, F.lit(True), row(code, " ", name)), ("COG", 0, opens["d"], _text(category, " ", w)), ("COG", 5, has_cog, _text(code, " ", name, " ", w)), ("COG", 6, key % 10 == 0, F.lit("INPC 100.0"))]
    elif version == 2013:
        made += [*split("CCIF", 5, F.lit(True)), ("SCIAN", 0, opens["d"], row(div, "-", _code(key % 9 + 10, 2), ". ", title)), ("SCIAN", 1, opens["g"], row("Rama ", key % 9000 + 1000, ". Rama ", title)), *split("SCIAN", 5, has_scian)]
    else:
        lasting = F.when(key % 5 < 4, _text(F.element_at(F.array(*(F.lit(x) for x in DURABILITIES)), (key % 5 + 1).cast("int")), gap)).otherwise("")
        made += [("CCIF", 5, F.lit(True), _text("  ", code, " ", name, gap, lasting, w)), ("CCIF", 6, key % 10 == 0, F.lit(" julio de 2018 "))]
    if version == 2018:
        made += [
            ("COG", 0, opens["d"], row(key % 9 + 1, ". ", title)), ("COG", 1, opens["g"], row(key % 9 + 1, ".", key % 7 + 1, ". Nivel ", title)), ("COG", 2, opens["c"], row(div, " ", title)), ("COG", 5, has_cog, row(code, " ", name)),
            ("SCIAN", 0, opens["d"], row(div, " ", title)), ("SCIAN", 1, opens["d"] & (key % 2 == 0), F.lit("   y sus servicios")), ("SCIAN", 2, opens["g"], row(key % 9000 + 1000, " Rama ", title)),
            ("SCIAN", 3, opens["g"] & (key % 3 == 0), F.lit("  y otras")), ("SCIAN", 4, key % 10 == 0, _text(" ", key % 900 + 10)), ("SCIAN", 5, has_scian, row(code, " ", name)), ("SCIAN", 6, key % 9 == 0, F.lit("una nota sin valor")),
        ]
    if version == 2024:
        made += [
            ("SCIAN", 0, opens["d"], _text(div, " ", title)), ("SCIAN", 1, opens["d"], F.lit("y otros comesti")), ("SCIAN", 2, opens["d"], F.lit("bles")), ("SCIAN", 3, opens["d"], w),
            ("SCIAN", 4, opens["g"], _text(key % 9000 + 1000, " Rama ", title, " ", w)), ("SCIAN", 5, has_scian, _text(code, " ", name, " Secundario ", w)), ("SCIAN", 6, key % 10 == 0, _text(key % 900 + 10)),
        ]
    each = F.array(*(F.when(when, F.struct(F.lit(annex).alias("anexo"), F.lit(k).alias("k"), text.alias("texto"))) for annex, k, when, text in made))
    rows = part.select("p_partkey", _text("manual ", key % 4).alias("documento"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    out = rows.select("documento", "x.anexo", (key * 20 + F.col("x.k")).alias("linea"), "x.texto")
    if version == 2013:
        end = [(f"manual {d}", "SCIAN", 10**12 + k, t) for d in range(4) for k, t in enumerate(("  Anexo III     0.0    0.0", "  001 after the end     1.0    1.0"))]
        out = out.unionByName(spark.createDataFrame(end, "documento string, anexo string, linea long, texto string"))
    page = F.lit(None).cast("int")
    for annex, (first, _) in PAGES[version].items():
        page = F.when(F.col("anexo") == annex, first + F.col("linea") % 2).otherwise(page)
    return out.withColumn("pagina", page)


def cells(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """documento, hoja, fila, columna, texto, numerico of four workbooks laid out as a version's."""
    layout = LAYOUTS[version]
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_retailprice"), F.col("p_partkey")
    name, title, price = _text(_code(key % 1000, 3), " ", F.col("p_name"), " ", key), _text(key % 90 + 10, " ", F.col("p_type")), F.format_string("%.2f", "p_retailprice")
    marks, columns = list(layout.marcas), []
    for sheet, opens in ((layout.hoja_cog, key % 24 < 4), (layout.hoja_ccif, key % 12 < 4)):
        if sheet is None:
            continue
        cell = lambda k, c, text, number, when, sheet=sheet: F.when(when, F.struct(F.lit(sheet).alias("hoja"), (key * 3 + k).alias("fila"), F.lit(c).alias("columna"), text.alias("texto"), F.lit(number).alias("numerico")))
        own = key % 5 != 2 if sheet == layout.hoja_ccif else F.lit(True)
        columns += [cell(0, layout.grupo or layout.generico, title, False, opens), cell(0, layout.ponderador, price, True, opens)]
        columns += [cell(1, layout.grupo or layout.generico, F.lit("Total"), False, key % 10 == 0), cell(1, layout.ponderador, price, True, key % 10 == 0)]
        columns += [cell(2, layout.generico, name, False, own), cell(2, layout.ponderador, F.when(key % 11 == 0, "n/d").otherwise(price), False, own & (key % 11 == 0)), cell(2, layout.ponderador, price, True, own & (key % 11 != 0))]
        columns += [cell(2, c, F.lit("X"), False, own & (key % len(marks) == k)) for k, c in enumerate(marks)]
        columns += [cell(2, layout.canasta_basica, F.when(key % 2 == 0, "X").otherwise("x"), False, own)]
        if layout.encadenamiento:
            columns += [cell(2, layout.encadenamiento, F.format_string("%d.125", key % 7), True, own)]
        if layout.consumo_minimo:
            columns += [cell(2, layout.consumo_minimo, F.lit("X"), False, own & (key % 3 == 0))]
    return part.select(_text("libro ", key % 4).alias("documento"), F.explode(F.filter(F.array(*columns), lambda x: x.isNotNull())).alias("x")).select("documento", "x.*")
