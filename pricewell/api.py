"""The operators by their everyday names; periods are texts such as `2Q Jul 2018` or `Jul 2018`."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from . import renames as names
from .errors import CalculationProblem, ConfigurationProblem, InvariantBroken
from .functions.periods import parse, parse_as
from .operators import axes, charts, consult, convert, incidence, laspeyres, validate, variation
from .scratch import swept, written
from .results import Result
from .sources import baskets, indicators, series
from .sources.official import Official
from .sources.ports import OfficialSource


#: Classifications that official figures exist for.
INDICES_VALIDABLES = catalog.COMPARABLE
#: The variable that may hold the token of the official source; it goes before one that is set.
TOKEN = "PRICEWELL_TOKEN"


@dataclass
class Settings:
    """Tolerances, timeout and token of a session."""

    index_tolerance: float = validate.INDEX_TOLERANCE
    point_tolerance: float = validate.POINT_TOLERANCE
    timeout: float = 10.0
    token: str | None = None


settings = Settings()


def set_token(token: str) -> None:
    if not token.strip():
        raise ConfigurationProblem("the token is empty")
    settings.token = token.strip()


def token() -> str:
    found = os.environ.get(TOKEN) or settings.token
    if not found:
        raise ConfigurationProblem(f"no token: set {TOKEN} or call set_token")
    return found


def reset_config() -> None:
    for name, value in asdict(Settings()).items():
        setattr(settings, name, value)


def mostrar_config() -> dict[str, object]:
    """The settings; of the token only whether there is one."""
    return asdict(settings) | {"token": bool(os.environ.get(TOKEN) or settings.token)}


def limpiar_cache(fuente: Official) -> None:
    """Fetched answers are forgotten."""
    fuente.clear()


def cargar_canasta(spark: SparkSession, ruta: str, version: int, resumen: bool = False) -> DataFrame:
    """The basket; with `resumen` its items and categories by classification are shown too."""
    out = written(baskets.read_basket(spark, ruta, _version(version)), "basket")
    laspeyres.check_basket(out)
    if resumen:
        baskets.summary(out).orderBy("tipo").show(truncate=False)
    return out


def cargar_serie(spark: SparkSession, ruta: str, version: int) -> DataFrame:
    with swept(spark):
        out = written(series.read_series(spark, ruta, _version(version)), "series")
    laspeyres.check_series(out)
    own = next(v for v in catalog.VERSIONS if v[0] == version)
    ends = out.agg(F.min("ord").alias("a"), F.max("ord").alias("z")).first()
    if ends.z < parse_as(own[1], "Q") or (own[2] and ends.a > parse_as(own[2], "Q")):
        raise InvariantBroken(f"the series has no period of version {version}")
    return out


def _version(version: int) -> int:
    if version not in [v[0] for v in catalog.VERSIONS]:
        raise ConfigurationProblem(f"unknown version {version}")
    return version


def calcular_indice(canasta: DataFrame, serie: DataFrame, tipo: str = "INPC", referencia: DataFrame | None = None) -> DataFrame:
    """The index of one version and classification. referencia: version, tipo, indice, referencia, from the version before."""
    ranges = catalog.ranges(canasta.sparkSession)
    classes = baskets.classes_of(canasta).where(F.col("tipo") == catalog.check_class(tipo))
    if not classes.limit(1).count():
        raise CalculationProblem(f"the basket has no categories of {tipo}")
    laspeyres.check_coverage(serie, canasta.join(classes.select("version", "generico"), ["version", "generico"], "left_semi"))
    raw = written(laspeyres.raw_index(serie, canasta.select("version", "generico", "ponderador", "encadenamiento"), classes, ranges), "raw")
    if referencia is not None:
        laspeyres.check_links(raw, ranges)
    return laspeyres.link(raw, ranges, referencia)


def _check_history(canastas: DataFrame, series_: DataFrame, referencia: str) -> None:
    """Raises before anything is computed: a reference that is no half month, no versions, unknown or not contiguous ones, a chained one without the one before."""
    parse_as(referencia, "Q")
    order = [v[0] for v in catalog.VERSIONS]
    found = sorted(r.version for r in canastas.select("version").distinct().limit(100).collect())
    if not found:
        raise InvariantBroken("there is no basket")
    unknown = [v for v in found if v not in order]
    if unknown:
        raise InvariantBroken(f"unknown versions {unknown}")
    if order[order.index(found[0]) :][: len(found)] != found:
        raise InvariantBroken(f"versions {found} are not contiguous in {order}")
    first = catalog.VERSIONS[order.index(found[0])]
    if first[3] in laspeyres.CHAINED:
        raise InvariantBroken(f"version {first[0]} is chained and needs the version before it")
    if canastas.groupBy("version", "generico").count().where("count > 1").limit(1).count():
        raise InvariantBroken("a version has an item twice: is its basket there twice?")
    lacking = canastas.select("version").distinct().join(series_.select("version").distinct(), "version", "left_anti").collect()  # a row a version
    if lacking:
        raise InvariantBroken(f"versions without series: {sorted(r.version for r in lacking)}")


def calcular_historia(canastas: DataFrame, series_: DataFrame, referencia: str = "2Q Jul 2018", mensual: bool = True, renombres: DataFrame | None = None, nombres_de: int | None = None) -> DataFrame:
    """All versions and classifications of the baskets in one plan: linked, spliced, rebased, then (if mensual) by months.

    Categories get the names of version `nombres_de` (the last one of the baskets by default) by the package's tables, after the user's own `renombres`.
    """
    _check_history(canastas, series_, referencia)
    ranges = catalog.ranges(canastas.sparkSession).join(F.broadcast(canastas.select("version").distinct()), "version", "left_semi")
    classes = baskets.classes_of(canastas)
    laspeyres.check_coverage(series_, canastas)
    target = nombres_de or canastas.agg(F.max("version")).first()[0]
    classes = written(names.to_version(classes, target, "categoria"), "classes") if renombres is None else classes
    raw = written(laspeyres.raw_index(series_, canastas.select("version", "generico", "ponderador", "encadenamiento"), classes, ranges), "raw")
    out = rebasar(written(convert.splice(convert.linked_history(raw, ranges, renombres)), "history"), referencia)
    return a_mensual(out) if mensual else out


def renombrar(indices: DataFrame, version: int) -> DataFrame:
    """Categories named as in a version."""
    return names.to_version(indices, version)


def empalmar(*tramos: DataFrame, forzar: bool = False, version_nombres: int | None = None, referencias: Sequence[str | None] | None = None) -> DataFrame:
    """Linked indices of several spans as one: categories named as in version `version_nombres` (the last one of the spans by default).

    Each span shares one period with the next and none with others; all pairs that don't are named in the error. At the shared period the earlier
    span owns the categories that it has. Of two categories that one name befalls, the first in the alphabet stays. `referencias` has the period at which each
    span was rebased (None: none); one that is not the period shared with the next may leave a step there: an error, or with `forzar` a warning.
    """
    if len(tramos) < 2:
        raise InvariantBroken("at least two spans are needed")
    rows = [t.agg(F.collect_set("tipo").alias("tipos"), F.collect_set("periodicidad").alias("p"), F.min("ord").alias("a"), F.max("version").alias("v")).first() for t in tramos]  # a row a span
    if len({tuple(sorted(r.tipos)) for r in rows}) > 1:
        raise InvariantBroken(f"spans must hold the same classifications, not {[sorted(r.tipos) for r in rows]}")
    found = {x for r in rows for x in r.p}
    if len(found) != 1:
        raise InvariantBroken(f"one periodicity is needed, not {sorted(found)}")
    if found == {"M"}:
        warnings.warn("spans of months: the shared month may lose a half; splice half months, then a_mensual", stacklevel=2)
    order = sorted(range(len(tramos)), key=lambda i: rows[i].a)
    versions = [rows[i].v for i in order]
    target = max(versions) if version_nombres is None else version_nombres
    known = [v for v in versions if v in [x[0] for x in catalog.VERSIONS]]
    if version_nombres is not None and known and not min(known) <= target <= max(known):
        raise InvariantBroken(f"version_nombres {target} lies outside of the spans' versions {known}")
    named = []
    for k, i in enumerate(order):
        # A span that was spliced before has the names of its last version throughout.
        own = tramos[i].withColumns({"_tramo": F.lit(k), "_own": F.col("version"), "_old": F.col("indice"), "version": F.lit(versions[k])})
        own = names.to_version(own, target) if versions[k] in known and target in [x[0] for x in catalog.VERSIONS] else own
        named.append(own.withColumn("version", F.col("_own")).drop("_own"))
    whole = named[0]
    for t in named[1:]:
        whole = whole.unionByName(t)
    whole = written(whole, "spans")
    shared = convert.check_spans(whole)
    for k, at in enumerate(shared):
        text = (referencias or [None] * len(tramos))[order[k]]
        if text is not None and parse(text)[1] != at:
            said = f"span {k} is rebased at {text}, not at the period that it shares with the next: rebase it first, or use forzar"
            if not forzar:
                raise InvariantBroken(said)
            warnings.warn(said, stacklevel=2)
    return convert.first_of(whole)


def rebasar(indices: DataFrame, periodo: str, valor_base: float = 100.0) -> DataFrame:
    return convert.rebase(indices, parse(periodo)[1], valor_base)


def a_mensual(indices: DataFrame) -> DataFrame:
    return convert.to_months(indices)


def _periodicity(rows: DataFrame) -> str:
    found = [r[0] for r in rows.select("periodicidad").distinct().limit(3).collect()]
    if len(found) != 1:
        raise InvariantBroken(f"one periodicity is needed, not {found}")
    return found[0]


def _ends(rows: DataFrame, desde: str | None, hasta: str | None) -> tuple[int | None, int | None]:
    p = _periodicity(rows)
    return (parse_as(desde, p) if desde else None), (parse_as(hasta, p) if hasta else None)


def variacion_periodica(indices: DataFrame, frecuencia: str) -> DataFrame:
    return variation.periodic(indices, frecuencia, _periodicity(indices))


def variacion_acumulada_anual(indices: DataFrame) -> DataFrame:
    return variation.year_to_date(indices, _periodicity(indices))


def variacion_desde(indices: DataFrame, desde: str, hasta: str | None = None, incluir_parciales: bool = True) -> DataFrame:
    a, z = _ends(indices, desde, hasta)
    return variation.from_to(indices, a, z, incluir_parciales)


def inflacion_en(variaciones: DataFrame, periodo: str) -> DataFrame:
    return consult.at(variation.values(variaciones), "variacion_pp", parse(periodo)[1])


def inflacion_acumulada(variaciones: DataFrame, desde: str | None = None, hasta: str | None = None) -> DataFrame:
    return consult.total(variation.values(variaciones), "variacion_pp", *_ends(variaciones, desde, hasta))


def inflacion_promedio(variaciones: DataFrame, desde: str | None = None, hasta: str | None = None, metodo: str = "tcac") -> DataFrame:
    own, ends = variation.values(variaciones), _ends(variaciones, desde, hasta)
    if metodo not in ("tcac", "simple"):
        raise ConfigurationProblem(f"unknown method {metodo!r}")
    return consult.annual_rate(own, _periodicity(variaciones), *ends) if metodo == "tcac" else consult.mean(own, "variacion_pp", *ends)


def inflacion_maxima(variaciones: DataFrame, desde: str | None = None, hasta: str | None = None, indice: str | None = None) -> DataFrame:
    return consult.extreme(variation.values(variaciones), "variacion_pp", True, *_ends(variaciones, desde, hasta), indice)


def inflacion_minima(variaciones: DataFrame, desde: str | None = None, hasta: str | None = None, indice: str | None = None) -> DataFrame:
    return consult.extreme(variation.values(variaciones), "variacion_pp", False, *_ends(variaciones, desde, hasta), indice)


def _weights(indices: DataFrame, canastas: DataFrame, renombres: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights of categories under the names of the result, ranges of the versions, and whether each classification is stable over the versions that it has.

    Without `renombres` (version, tipo, indice, nuevo) the result's own names tell which version's they are, and the package's tables lead there.
    """
    classes = written(baskets.classes_of(canastas), "classes")
    used = indices.select("version", "tipo").distinct()
    own = classes.join(F.broadcast(used), ["version", "tipo"], "left_semi")  # a row a version and classification
    if renombres is None:
        renombres = written(names.canonical(indices, classes), "renames")
        steady = incidence.stable(names.aligned(own))
    else:
        steady = incidence.stable(names.aligned_items(own), renombres)
    return written(incidence.weights(canastas, classes, renombres), "weights"), catalog.ranges(canastas.sparkSession), written(steady, "stable")


def incidencia_periodica(indices: DataFrame, canastas: DataFrame, frecuencia: str, renombres: DataFrame | None = None, frontera: DataFrame | None = None) -> DataFrame:
    """indices holds headline and categories; frontera (of the half months) is needed for exact months across baskets."""
    incidence.check_inputs(indices, canastas)
    return incidence.periodic(indices, *_weights(indices, canastas, renombres), frecuencia, _periodicity(indices), frontera)


def incidencia_acumulada_anual(indices: DataFrame, canastas: DataFrame, renombres: DataFrame | None = None, frontera: DataFrame | None = None) -> DataFrame:
    incidence.check_inputs(indices, canastas)
    return incidence.year_to_date(indices, *_weights(indices, canastas, renombres), _periodicity(indices), frontera)


def incidencia_desde(indices: DataFrame, canastas: DataFrame, desde: str | None = None, hasta: str | None = None, incluir_parciales: bool = True, renombres: DataFrame | None = None, frontera: DataFrame | None = None) -> DataFrame:
    incidence.check_inputs(indices, canastas)
    a, z = _ends(indices, desde, hasta)
    whole = indices.agg(F.min("ord").alias("a"), F.max("ord").alias("z")).first()
    a, z = whole.a if a is None else a, whole.z if z is None else z
    return incidence.from_to(indices, *_weights(indices, canastas, renombres), a, z, _periodicity(indices), incluir_parciales, frontera)


def incidencia_en(incidencias: DataFrame, periodo: str) -> DataFrame:
    return consult.at(incidencias.where("computable"), "incidencia_pp", parse(periodo)[1])


def incidencia_acumulada(incidencias: DataFrame, desde: str | None = None, hasta: str | None = None) -> DataFrame:
    return consult.total(incidencias.where("computable"), "incidencia_pp", *_ends(incidencias, desde, hasta))


def incidencia_promedio(incidencias: DataFrame, desde: str | None = None, hasta: str | None = None) -> DataFrame:
    return consult.mean(incidencias.where("computable"), "incidencia_pp", *_ends(incidencias, desde, hasta))


def mayor_incidencia(incidencias: DataFrame, desde: str | None = None, hasta: str | None = None) -> DataFrame:
    return consult.extreme(incidencias.where("computable"), "incidencia_pp", True, *_ends(incidencias, desde, hasta))


def menor_incidencia(incidencias: DataFrame, desde: str | None = None, hasta: str | None = None) -> DataFrame:
    return consult.extreme(incidencias.where("computable"), "incidencia_pp", False, *_ends(incidencias, desde, hasta))


def validar_indice(indices: DataFrame, oficial: DataFrame) -> DataFrame:
    return validate.compare(indices, oficial, "indice_replicado", settings.index_tolerance)


def validar_variacion(variaciones: DataFrame, oficial: DataFrame) -> DataFrame:
    return validate.compare(variaciones, oficial, "variacion_pp", settings.point_tolerance)


def validar_incidencia(incidencias: DataFrame, oficial: DataFrame) -> DataFrame:
    return validate.compare(incidencias, oficial, "incidencia_pp", settings.point_tolerance)


def validar(resultado: Result, fuente: Callable[[], OfficialSource]) -> Result:
    """A result against the official source, which is built only when its rows have passed the checks, so that these come before any token or fetch."""
    rows, kind = resultado.rows, resultado.clase
    if kind == "validacion":
        raise ConfigurationProblem("a comparison can't be compared again")
    strange = [r.tipo for r in rows.select("tipo").distinct().where(~F.col("tipo").isin(*INDICES_VALIDABLES)).limit(3).collect()]
    if strange:
        raise ConfigurationProblem(f"no official figures for {strange}; there are for {list(INDICES_VALIDABLES)}")
    if not rows.limit(1).count():
        raise InvariantBroken("there are no periods to compare")
    periodicity, measure = _periodicity(rows), "indice"
    if kind != "indice":
        found = [r[0] for r in rows.select(f"clase_{kind}").distinct().limit(2).collect()]
        measure = indicators.measure_of(found[0], periodicity) if len(found) == 1 else None
        if kind == "incidencia":
            measure = "incidencia" if (measure, periodicity) == ("periodica", "M") else None
    if measure is None:
        raise InvariantBroken(f"no official figures of {kind} for {found} by {periodicity}")
    official = fuente().at(rows.select("ord").distinct(), periodicity, measure)
    compare = {"indice": validar_indice, "variacion": validar_variacion, "incidencia": validar_incidencia}[kind]
    return Result(compare(rows, official), "validacion", resultado.manifiesto)


@dataclass(frozen=True)
class Grafica:
    """What a chart needs, as DataFrames: a drawing library takes them from here by toPandas()."""

    filas: DataFrame  # rows to draw, with panel, linea and turno (remainders first, headline last)
    leyenda: DataFrame  # panel, indice, color, etiqueta
    etiquetas: DataFrame  # ord: the labelled periods
    cortes: DataFrame  # panel, corte: breaks of the value axis
    puntos: DataFrame  # rows that carry a point
    extremos: DataFrame  # panel, indice, extremo, ord and the value: marks of panels with one line
    titulo: str
    eje: str


def preparar_grafica(resultado: Result, comparacion: Result | None = None, desde: str | None = None, hasta: str | None = None, referencia: str | None = None) -> Grafica:
    """Lines of an index or a variation, in panels of eight categories with the headline in each, or the stacked bars of contributions.

    The range is checked before anything else. A comparison has the same kind and periodicity; for contributions it is the headline's variation of the same
    class, a line of its own.
    """
    kind = resultado.clase
    if kind not in ("indice", "variacion", "incidencia"):
        raise ConfigurationProblem(f"a result of kind {kind!r} has no chart")
    value, base = Result.VALUES[kind], 100.0 if kind == "indice" else 0.0
    own = resultado.rows.where("computable") if kind != "indice" else resultado.rows
    periodicity = _periodicity(own)
    if comparacion is not None:
        wanted = "variacion" if kind == "incidencia" else kind
        if comparacion.clase != wanted or _periodicity(comparacion.rows) != periodicity:
            raise ConfigurationProblem(f"a comparison must be of kind {wanted!r} and of periodicity {periodicity!r}")
        classes = [r.rows.select(f"clase_{r.clase}").distinct().limit(2).collect() for r in (resultado, comparacion) if r.clase != "indice"]
        if len({tuple(r[0] for r in c) for c in classes}) > 1:
            raise ConfigurationProblem("a comparison must be of the same class")
    other = None
    if comparacion is not None:
        other = comparacion.rows if kind == "indice" else comparacion.rows.where("computable")
        other = other.select("tipo", "ord", "indice", F.col(Result.VALUES[comparacion.clase]).alias(value))
    both = charts.combined(own.select("tipo", "ord", "indice", value), other)
    # Contributions must have the range themselves: a line alone would leave a chart without bars.
    consult.check_range(own if kind == "incidencia" else both, *(parse_as(x, periodicity) if x else None for x in (desde, hasta)))
    rows = consult.in_range(both, *(parse_as(x, periodicity) if x else None for x in (desde, hasta))).where(F.col(value).isNotNull())
    if kind == "incidencia":
        bars = charts.stacked(rows.where("linea = 'resultado'"), value).withColumn("linea", F.lit("resultado"))
        drawn = bars.unionByName(rows.where("linea = 'comparacion'").select("ord", "indice", value, "linea")).withColumn("panel", F.lit(0))
        heights = charts.stack_ends(bars, value).select(F.lit(0).alias("panel"), F.explode(F.array("arriba", "abajo")).alias(value))
        ends = heights.unionByName(drawn.where("linea = 'comparacion'").select("panel", value))
    else:
        named = charts.panels(rows)
        every = named.where("panel is not null").select("panel").distinct()
        head = named.where("panel is null").select("indice").join(F.broadcast(every), F.lit(True), "left").withColumn("panel", F.coalesce("panel", F.lit(0)))
        drawn = rows.join(F.broadcast(named.where("panel is not null").unionByName(head)), "indice").select("ord", "indice", value, "linea", "panel")
        ends = drawn.select("panel", value)
    drawn = drawn.withColumn("turno", charts.draw_order(F.col("indice")))
    tipos = [r.tipo for r in rows.select("tipo").distinct().orderBy("tipo").collect()]  # a row a classification
    label = {"indice": "Indice" if referencia is None else f"Indice ({referencia} = 100)", "variacion": "Variación (pp)", "incidencia": "Incidencia (pp)"}[kind]
    return Grafica(drawn, axes.legend(drawn, "panel", distinct=True), axes.period_labels(drawn), axes.value_breaks(ends, value, base, "panel"), charts.points(drawn, periodicity), axes.ends_to_mark(drawn, value, "panel"), " + ".join(tipos), label)


def _official(fuente: OfficialSource, tipo: str, periodicidad: str, measure: str) -> DataFrame:
    if tipo.upper() not in INDICES_VALIDABLES:
        raise ConfigurationProblem(f"no official figures for {tipo!r}")
    if periodicidad not in ("Q", "M"):
        raise ConfigurationProblem(f"periodicity must be Q or M, not {periodicidad!r}")
    return fuente.history(periodicidad, measure).where(F.col("tipo") == tipo.upper()).groupBy("ord").pivot("indice").agg(F.first("oficial")).orderBy("ord")


def consultar_indice(fuente: OfficialSource, tipo: str = "INPC", periodicidad: str = "M") -> DataFrame:
    """Official indices as published: a row a period, a column a category."""
    return _official(fuente, tipo, periodicidad, "indice")


def consultar_variacion(fuente: OfficialSource, tipo: str = "INPC", clase: str = "periodica", periodicidad: str = "M") -> DataFrame:
    if clase not in ("periodica", "anual", "acumulada_anual"):
        raise ConfigurationProblem(f"unknown class {clase!r}")
    return _official(fuente, tipo, periodicidad, clase)


def consultar_incidencia(fuente: OfficialSource, tipo: str = "INPC") -> DataFrame:
    return _official(fuente, tipo, "M", "incidencia")
