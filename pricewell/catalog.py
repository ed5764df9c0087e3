"""Versions, classification columns and the names that categories have in each version."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationProblem
from .functions.periods import parse_as

#: Versions with their first and last half month (both ends inclusive) and how they are linked.
VERSIONS = (
    (2010, "2Q Dic 2010", "2Q Mar 2013", "directo"),
    (2013, "2Q Mar 2013", "2Q Jul 2018", "t1"),
    (2018, "2Q Jul 2018", "2Q Jul 2024", "directo"),
    (2024, "2Q Jul 2024", None, "t2"),
)
#: Classification columns of a basket; the first five are never empty.
CLASSES = (
    "COG",
    "INFLACION COMPONENTE",
    "INFLACION SUBCOMPONENTE",
    "INFLACION AGRUPACION",
    "CANASTA BASICA",
    "CCIF DIVISION",
    "CCIF GRUPO",
    "CCIF CLASE",
    "SCIAN SECTOR",
    "SCIAN RAMA",
    "DURABILIDAD",
    "CANASTA CONSUMO MINIMO",
)
CORE_CLASSES = CLASSES[:5]
HEADLINE = "INPC"
#: Classifications that official figures exist for.
COMPARABLE = (HEADLINE, "INFLACION COMPONENTE", "INFLACION SUBCOMPONENTE")


def ranges(spark: SparkSession) -> DataFrame:
    rows = [(v, parse_as(a, "Q"), parse_as(b, "Q") if b else None, m) for v, a, b, m in VERSIONS]
    return spark.createDataFrame(rows, "version int, ini int, fin int, metodo string")


def check_class(name: str) -> str:
    """The classification in upper case; raises if there is none of that name."""
    found = name.upper()
    if found != HEADLINE and found not in CLASSES:
        raise ConfigurationProblem(f"unknown classification {name!r}")
    return found


def rename_map(steps: Iterable[tuple[int, int, str, str, str]], version: int, target: int, order: tuple[int, ...] = tuple(v[0] for v in VERSIONS)) -> dict[tuple[str, str], str]:
    """(tipo, name in `version`) → name in `target`, through the steps between neighbours (from, to, tipo, old, new), forward or back."""
    by_step: dict[tuple[int, int], dict[tuple[str, str], str]] = {}
    for a, b, kind, old, new in steps:
        by_step.setdefault((a, b), {})[kind, old] = new
        by_step.setdefault((b, a), {})[kind, new] = old
    i, j = order.index(version), order.index(target)
    path = order[i : j + 1] if i <= j else order[j : i + 1][::-1]
    found: dict[tuple[str, str], str] = {}
    for a, b in zip(path, path[1:], strict=False):
        step = by_step.get((a, b), {})
        moved = {key: step.get((key[0], name), name) for key, name in found.items()}
        reached = {(key[0], name) for key, name in found.items()}
        found = moved | {key: new for key, new in step.items() if key not in reached and key not in moved}
    return {k: v for k, v in found.items() if k[1] != v}


def renames(spark: SparkSession, steps: list[tuple[int, int, str, str, str]], target: int, versions: Iterable[int] | None = None) -> DataFrame:
    """version, tipo, indice, nuevo for all versions; the steps are the user's catalogue."""
    rows = [(v, kind, old, new) for v in (versions or [x[0] for x in VERSIONS]) if v != target for (kind, old), new in rename_map(steps, v, target).items()]
    return spark.createDataFrame(rows, "version int, tipo string, indice string, nuevo string")
