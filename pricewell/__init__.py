"""Price indices and training-data operators on Spark. The everyday verbs, settings and errors are names of the package itself."""

from __future__ import annotations

_VERBS = (
    "INDICES_VALIDABLES", "a_mensual", "calcular_historia", "calcular_indice", "cargar_canasta", "cargar_serie", "consultar_incidencia", "consultar_indice", "consultar_variacion",
    "empalmar", "incidencia_acumulada", "incidencia_acumulada_anual", "incidencia_desde", "incidencia_en", "incidencia_periodica", "incidencia_promedio", "inflacion_acumulada", "inflacion_en",
    "inflacion_maxima", "inflacion_minima", "inflacion_promedio", "Grafica", "limpiar_cache", "mayor_incidencia", "menor_incidencia", "mostrar_config", "preparar_grafica", "rebasar", "renombrar", "reset_config", "set_token", "settings",
    "validar", "validar_incidencia", "validar_indice", "validar_variacion", "variacion_acumulada_anual", "variacion_desde", "variacion_periodica",
)
_ERRORS = (
    "CalculationProblem", "ColumnsMissing", "ConfigurationProblem", "DomainProblem", "EncodingUnreadable", "FileCorrupt", "FileEmpty", "FileMissing", "ImportProblem", "InvariantBroken",
    "OrientationUnknown", "PeriodUnavailable", "PeriodUnreadable", "PricewellError", "ResponseInvalid", "SeriesEmpty", "SourceUnavailable", "ValidationProblem",
)
__all__ = [*_VERBS, *_ERRORS, "Result", "parse", "text_of"]


def __getattr__(name: str) -> object:
    """Loads a name when it is first used, so that tasks which need one module load that one."""
    if name in _VERBS:
        from . import api as home
    elif name in _ERRORS:
        from . import errors as home
    elif name == "Result":
        from . import results as home
    elif name in ("parse", "text_of"):
        from .functions import periods as home
    else:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(home, name)
