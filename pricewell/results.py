"""Results as one DataFrame with its views, and the rules that each kind of result keeps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import COMPARABLE
from .errors import InvariantBroken
from .functions.periods import LAGS
from .operators import consult, convert, validate
from .operators.variation import missing

KEY = ("tipo", "ord", "indice")
#: States of an index, of a derived value, and classes of derived results.
INDEX_STATES = ("ok", "parcial", "rellenado", "sin_datos", "fallida")
DERIVED_STATES = ("ok", "parcial")
DERIVED_CLASSES = (*(f"periodica_{f}" for f in LAGS["Q"]), "acumulada_anual", "desde")


def _columns(rows: DataFrame, *wanted: str) -> None:
    lacking = [c for c in wanted if c not in rows.columns]
    if lacking:
        raise InvariantBroken(f"a result lacks the columns {lacking}")


def check_keys(rows: DataFrame) -> None:
    """Raises if there are no rows, or several of one classification, period and category."""
    _columns(rows, *KEY)
    if not rows.limit(1).count():
        raise InvariantBroken("a result has no rows")
    again = rows.groupBy(*KEY).count().where("count > 1").limit(1).collect()
    if again:
        raise InvariantBroken(f"a result has {again[0]['count']} rows of {again[0].indice!r} at {again[0].ord}")


def _homogeneous(rows: DataFrame, column: str, known: tuple[str, ...]) -> str:
    found = [r[0] for r in rows.select(column).distinct().limit(3).collect()]
    if len(found) != 1 or found[0] not in known:
        raise InvariantBroken(f"{column} must be one of {known}, not {found}")
    return found[0]


def check_index(rows: DataFrame, versions: DataFrame | None = None) -> None:
    """Raises unless keys are unique, states known and each (version, tipo) of `versions` has rows."""
    _columns(rows, "version", "indice_replicado", "estado_calculo", "motivo_error")
    check_keys(rows)
    bad = rows.where(~F.col("estado_calculo").isin(*INDEX_STATES)).select("estado_calculo").limit(1).collect()
    if bad:
        raise InvariantBroken(f"unknown state {bad[0][0]!r}")
    if versions is not None:
        lacking = versions.select("version", "tipo").join(rows.select("version", "tipo").distinct(), ["version", "tipo"], "left_anti").limit(1).collect()
        if lacking:
            raise InvariantBroken(f"version {lacking[0].version} of {lacking[0].tipo} has no rows")


def check_derived(rows: DataFrame, kind: str, value: str) -> None:
    """Raises unless computable rows have unique keys, one class, finite values and known states; kind: clase_variacion or clase_incidencia."""
    _columns(rows, kind, value, "estado_calculo", "computable")
    own = rows.where("computable")
    check_keys(own)
    _homogeneous(rows, kind, DERIVED_CLASSES)
    off = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | ~F.col("estado_calculo").isin(*DERIVED_STATES)
    bad = own.where(off).limit(1).collect()
    if bad:
        raise InvariantBroken(f"{bad[0].indice!r} at {bad[0].ord} is computable with {bad[0][value]} in state {bad[0].estado_calculo!r}")


def check_compared(rows: DataFrame) -> None:
    """Raises unless a comparison has its columns, known states and classifications that official figures exist for."""
    _columns(rows, *KEY, "oficial", "error", "estado_validacion")
    bad = rows.where(~F.col("estado_validacion").isin(*validate.STATES) | ~F.col("tipo").isin(*COMPARABLE)).limit(1).collect()
    if bad:
        raise InvariantBroken(f"{bad[0].tipo!r} is in state {bad[0].estado_validacion!r}")


@dataclass
class Result:
    """Rows of one kind: `indice`, `variacion`, `incidencia` or `validacion`. `manifiesto` says what they were made of; views are lazy DataFrames."""

    rows: DataFrame
    clase: str
    manifiesto: list[dict] = field(default_factory=list)

    #: The value column of each kind.
    VALUES = {"indice": "indice_replicado", "variacion": "variacion_pp", "incidencia": "incidencia_pp", "validacion": "error"}

    def __post_init__(self) -> None:
        if self.clase not in self.VALUES:
            raise InvariantBroken(f"unknown kind of result {self.clase!r}")

    def check(self) -> Result:
        """Runs the rules of its kind; returns itself."""
        if self.clase == "indice":
            versions = [(m["version"], m["tipo"]) for m in self.manifiesto]
            check_index(self.rows, self.rows.sparkSession.createDataFrame(versions, "version int, tipo string") if versions else None)
        elif self.clase == "validacion":
            check_compared(self.rows)
        else:
            check_derived(self.rows, f"clase_{self.clase}", self.VALUES[self.clase])
        return self

    @cached_property
    def resultado(self) -> DataFrame:
        """The rows with a value, in order of period and category."""
        own = self.rows.where("computable") if "computable" in self.rows.columns else self.rows
        return own.orderBy("ord", "indice")

    @cached_property
    def ancho(self) -> DataFrame:
        """One row a category, one column a period."""
        return consult.wide(self.resultado, [self.VALUES[self.clase]])

    @cached_property
    def reporte(self) -> DataFrame:
        """All rows and columns."""
        return self.rows

    @cached_property
    def diagnostico(self) -> DataFrame:
        """What has no value, or no agreement, and why."""
        if self.clase == "validacion":
            return validate.failures(self.rows)
        return missing(self.rows) if "computable" in self.rows.columns else self.rows.where(F.col("indice_replicado").isNull())

    @cached_property
    def resumen(self) -> DataFrame:
        if self.clase == "validacion":
            derived = next((c for c in self.rows.columns if c in ("clase_variacion", "clase_incidencia")), None)
            return validate.derived_summary(self.rows, "tipo", derived) if derived else validate.summary(self.rows, "version", "tipo")
        if self.clase == "indice":
            return convert.summary(self.rows)
        value = F.col(self.VALUES[self.clase])
        return self.resultado.groupBy("tipo").agg(F.min("ord").alias("desde"), F.max("ord").alias("hasta"), F.count("*").alias("filas"), F.min(value).alias("minimo"), F.max(value).alias("maximo"))

    def _repr_html_(self) -> str:
        return f"<p>{self.clase}: {', '.join(self.rows.columns)}</p>" + self.resultado.limit(20).toPandas().to_html(index=False)
