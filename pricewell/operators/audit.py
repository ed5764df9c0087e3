"""Two extracts of one basket resolved column by column, and the audit documents of a run: nested counts as maps, one JSON text a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationProblem
from ..functions.text import decimals, equal_when_rounded
from ..sources.baskets import FILE_COLUMNS
from .extracts import check_same_items

#: Which extracts may have a column, by version; columns that are not named have no source there.
BOTH, XLSX, PDF = ("xlsx", "pdf"), ("xlsx",), ("pdf",)
SOURCES = {
    2010: {
        "ponderador": BOTH, "COG": BOTH, "CCIF division": PDF, "CCIF grupo": PDF, "CCIF clase": PDF, "inflacion componente": XLSX, "inflacion subcomponente": XLSX, "inflacion agrupacion": XLSX, "canasta basica": XLSX,
    },
    2013: {
        "ponderador": BOTH, "encadenamiento": BOTH, "COG": XLSX, "CCIF division": BOTH, "CCIF grupo": PDF, "CCIF clase": PDF, "inflacion componente": XLSX, "inflacion subcomponente": XLSX, "inflacion agrupacion": XLSX,
        "SCIAN sector": PDF, "SCIAN rama": PDF, "canasta basica": XLSX,
    },
    2018: {
        "ponderador": BOTH, "COG": BOTH, "CCIF division": BOTH, "CCIF grupo": PDF, "CCIF clase": PDF, "inflacion componente": XLSX, "inflacion subcomponente": XLSX, "inflacion agrupacion": XLSX,
        "SCIAN sector": PDF, "SCIAN rama": PDF, "durabilidad": PDF, "canasta basica": XLSX,
    },
    2024: {
        "ponderador": BOTH, "encadenamiento": XLSX, "COG": XLSX, "CCIF division": BOTH, "CCIF grupo": PDF, "CCIF clase": PDF, "inflacion componente": XLSX, "inflacion subcomponente": XLSX, "inflacion agrupacion": XLSX,
        "SCIAN sector": PDF, "SCIAN rama": PDF, "durabilidad": PDF, "canasta basica": XLSX, "canasta consumo minimo": XLSX,
    },
}
BY_ROW, CODED = ("ponderador", "encadenamiento"), ("CCIF division", "CCIF grupo", "CCIF clase")
CLASSES = FILE_COLUMNS[3:]
CODE = r"^\d+(\.\d+)*\s+"
UNCLASSIFIED = "sin_clasificar"


def _long(extract: DataFrame, side: str, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in extract.columns else F.lit("")).alias(side)) for c in columns)))
    return extract.select("generico", cells.alias("c")).select("generico", "c.*")


def resolutions(xlsx: DataFrame, pdf: DataFrame, version: int, prefer: str | None = "pdf", answers: DataFrame | None = None) -> DataFrame:
    """generico, columna, valor_xlsx, valor_pdf, valor_final, origen, metodo of every item and column; metodo is null where nothing was to decide.

    All columns at once: numbers agree (igual), agree when rounded (redondeo: the more precise stays) or are decided; categories likewise, those of CCIF without
    their code, which the sheet never has: its name gets the other side's code (origen mixto). A decision takes the preferred side (preferido); without one the
    answer given for the pair (columna, valor_xlsx, valor_pdf, origen), else the manual (interactiva). Columns of one side are taken as they are (directo).
    """
    if version not in SOURCES or prefer not in ("xlsx", "pdf", None):
        raise ConfigurationProblem(f"unknown version {version} or side {prefer!r}")
    check_same_items(xlsx, pdf)
    has = SOURCES[version]
    two, only_x, only_p = ([c for c in FILE_COLUMNS if has.get(c) == s] for s in (BOTH, XLSX, PDF))
    both = _long(xlsx, "valor_xlsx", two).join(_long(pdf, "valor_pdf", two), ["generico", "columna"])
    if prefer is None and answers is not None:
        both = both.join(answers.select("columna", "valor_xlsx", "valor_pdf", F.col("origen").alias("_said")), ["columna", "valor_xlsx", "valor_pdf"], "left")
    side = F.lit(prefer) if prefer else F.when(F.col("_said") == "xlsx", "xlsx").otherwise("pdf") if answers is not None else F.lit("pdf")
    x, p, column = F.col("valor_xlsx"), F.col("valor_pdf"), F.col("columna")
    coded, number = column.isin(*CODED), column.isin(*BY_ROW)
    bare = lambda c: F.when(coded, F.regexp_replace(c, CODE, "")).otherwise(c)
    near = number & F.coalesce(equal_when_rounded(x, p), F.lit(False))
    precise = F.when(decimals(x) >= decimals(p), "xlsx").otherwise("pdf")
    code = F.regexp_extract(p, r"^(\d+(?:\.\d+)*\s+)", 1)
    mixed = coded & (side == "xlsx") & (x != "") & (code != "")
    same, alike = x == p, bare(x) == bare(p)
    method = F.when(same | alike, F.when(number | (p != ""), "igual")).when(near, "redondeo").otherwise("preferido" if prefer else "interactiva")
    origin = F.when(same, "ambas").when(alike, "pdf").when(near, precise).when(mixed, "mixto").otherwise(side)
    final = F.when(same | alike, p).when(near, F.when(precise == "xlsx", x).otherwise(p)).when(mixed, F.concat(code, x)).when(side == "xlsx", x).otherwise(p)
    out = both.select("generico", "columna", "valor_xlsx", "valor_pdf", final.alias("valor_final"), origin.alias("origen"), method.alias("metodo"))
    none = F.lit(None).cast("string")
    for extract, own, name in ((xlsx, only_x, "xlsx"), (pdf, only_p, "pdf")):
        if own:
            value = F.col("v")
            some = F.when(column.isin(*BY_ROW) | (value != ""), "directo")
            out = out.unionByName(_long(extract, "v", own).select("generico", "columna", (value if name == "xlsx" else none).alias("valor_xlsx"), (value if name == "pdf" else none).alias("valor_pdf"), value.alias("valor_final"), F.lit(name).alias("origen"), some.alias("metodo")))
    return out


def resolved(resolved_rows: DataFrame) -> DataFrame:
    """The basket that the resolutions give: the fifteen columns; those without a source are empty."""
    cell = lambda c: F.coalesce(F.max(F.when(F.col("columna") == c, F.col("valor_final"))), F.lit("")).alias(c)
    return resolved_rows.groupBy("generico").agg(*(cell(c) for c in FILE_COLUMNS[1:]))


def _map(key: str, value: str) -> Column:
    """A map in order of its keys; its values need have none."""
    entries = F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))


def class_counts(basket: DataFrame, columns: tuple[str, ...] = CLASSES) -> DataFrame:
    """columna, clasificacion: items with a category, number of categories and a map of the items of each."""
    rows = _long(basket, "v", [c for c in columns if c in basket.columns])
    n = rows.groupBy("columna", F.when(F.col("v") != "", F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy("columna").agg(F.struct(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("genericos_clasificados"), F.count("v").alias("categorias_unicas"), _map("v", "n").alias("categorias")).alias("clasificacion"))


def method_tree(rows: DataFrame) -> DataFrame:
    """columna, clasificacion: items, number of categories, and for each category a map of methods and, where there are any, of the origins of each method.

    Counts are nested by three aggregations of ever fewer rows. Decisions for an empty value are listed as sin_clasificar and are no category.
    """
    how = F.col("metodo")
    key = F.when(how.isin("preferido", "interactiva"), "decision").otherwise(how)
    own = rows.where(F.col("columna").isin(*CLASSES)).select("columna", "valor_final", key.alias("m"), F.when(how.isNotNull(), F.col("origen")).alias("o"))
    fine = own.groupBy("columna", "valor_final", "m", "o").agg(F.count("*").alias("n"))
    named = F.when(F.col("valor_final") == "", UNCLASSIFIED).otherwise(F.col("valor_final"))
    coarse = fine.groupBy("columna", "valor_final", "m").agg(F.sum("n").alias("n"), _map("o", "n").alias("origins"))
    origins = lambda m: F.max_by(F.when(F.col("m") == m, F.col("origins")), F.col("m") == m)
    shown = lambda m: F.when(F.size(origins(m)) > 0, origins(m)).alias(f"origenes_{m}")
    kinds = coarse.groupBy("columna", "valor_final").agg(
        F.sum("n").alias("n"), F.count("m").alias("events"), F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.col("n"))), F.lit(0)).alias("decided"), _map("m", "n").alias("metodos"), shown("igual"), shown("decision"), shown("directo"),
    )
    real = F.col("valor_final") != ""
    entry = F.struct(F.when(real, F.col("n")).otherwise(F.col("decided")).alias("genericos"), "metodos", "origenes_igual", "origenes_decision", "origenes_directo")
    each = kinds.withColumn("k", F.when(real | (F.col("events") > 0), named)).withColumn("e", entry)
    return each.groupBy("columna").agg(F.struct(F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("genericos"), F.count_if(real).alias("categorias_unicas"), _map("k", "e").alias("categorias")).alias("clasificacion"))


def _json(one: DataFrame, *fields: Column) -> DataFrame:
    """One row with the document as JSON; what is null is left out, as within the categories, but for fields that a version lacks."""
    return one.select(F.to_json(F.struct(*fields)).alias("registro"))


def _heads(basket: DataFrame, detail: Column, chained: bool) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return basket.agg(F.count("*").alias("genericos"), filled("ponderador").alias("ponderadores"), (filled("encadenamiento") if chained else F.lit(None).cast("long")).alias("encadenamientos"), F.array_sort(F.collect_list(detail)).alias("genericos_detalle"))


def _tree(counts: DataFrame) -> DataFrame:
    return counts.agg(_map("columna", "clasificacion").alias("clasificaciones"))


def _document(kind: str, heads: DataFrame, counts: DataFrame, facts: dict[str, object]) -> DataFrame:
    """Both sides are one row."""
    own = [F.lit(kind).alias("tipo"), *(F.lit(v).alias(k) for k, v in facts.items())]
    rest = [c for c in heads.columns if c != "genericos_detalle"]
    return _json(heads.join(_tree(counts), F.lit(True)), *own, *rest, F.col("clasificaciones"), F.col("genericos_detalle"))


def xlsx_document(basket: DataFrame, version: int, **facts: object) -> DataFrame:
    """registro: the JSON document of a run over a workbook alone."""
    chained = "encadenamiento" in basket.columns
    detail = F.struct("generico", "ponderador", *(["encadenamiento"] if chained else []))
    return _document("xlsx", _heads(basket, detail, chained), class_counts(basket), facts | {"version": version})


def cross_document(rows: DataFrame, version: int, prefer: str | None = "pdf", **facts: object) -> DataFrame:
    """registro: the JSON document of a run over workbook and manual, from its resolutions."""
    chained = bool(SOURCES[version].get("encadenamiento"))
    field = lambda c: F.max(F.when(F.col("columna") == c, F.struct(F.col("valor_final").alias("valor"), "origen", "metodo"))).alias(c)
    numbers = rows.where(F.col("columna").isin(*BY_ROW)).groupBy("generico").agg(*(field(c) for c in BY_ROW))
    filled = lambda c: F.count_if(F.coalesce(F.col(f"{c}.valor"), F.lit("")) != "")
    detail = F.struct("generico", "ponderador", *(["encadenamiento"] if chained else []))
    heads = numbers.agg(F.count("*").alias("genericos"), filled("ponderador").alias("ponderadores"), (filled("encadenamiento") if chained else F.lit(None).cast("long")).alias("encadenamientos"), F.array_sort(F.collect_list(detail)).alias("genericos_detalle"))
    return _document("xlsx_pdf", heads, method_tree(rows), {"preferir": prefer} | facts | {"version": version})


def synchronised(target: DataFrame, source: DataFrame, columns: tuple[str, ...] = ("SCIAN sector", "SCIAN rama")) -> DataFrame:
    """The target with `columns` from the source by item, and cambios: how many of them are new for the item. Both must have the same items."""
    check_same_items(target, source)
    other = source.select("generico", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"_new_{i}") for i, c in enumerate(columns)))
    both = target.join(other, "generico")
    changed = lambda i, c: (F.coalesce(F.col(f"`{c}`"), F.lit("")) != F.col(f"_new_{i}")).cast("int") if c in target.columns else (F.col(f"_new_{i}") != "").cast("int")
    total = F.lit(0)
    for i, c in enumerate(columns):
        total = total + changed(i, c)
    both = both.withColumn("cambios", total)
    for i, c in enumerate(columns):
        both = both.withColumn(c, F.col(f"_new_{i}"))
    return both.drop(*(f"_new_{i}" for i in range(len(columns))))


def sync_document(done: DataFrame, columns: tuple[str, ...] = ("SCIAN sector", "SCIAN rama"), **facts: object) -> DataFrame:
    """registro: the JSON document of a basket that got columns of another version's."""
    detail = F.struct("generico", *(F.col(f"`{c}`") for c in columns), (F.col("cambios") > 0).alias("cambio"))
    heads = done.agg(F.count("*").alias("genericos"), F.coalesce(F.sum("cambios"), F.lit(0)).alias("celdas_actualizadas"), F.array_sort(F.collect_list(detail)).alias("genericos_detalle"))
    return _document("sincronizacion", heads, class_counts(done, columns), {"version_fuente": 2013, "version_destino": 2010} | facts)


def write_document(document: DataFrame, path: str) -> None:
    """A folder with the document as one text file; a basket has some hundred items."""
    document.coalesce(1).write.mode("overwrite").text(path)
