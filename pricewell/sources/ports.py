"""What readers of baskets and series, and sources of official figures, must offer."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class BasketReader(Protocol):
    def __call__(self, spark: SparkSession, path: str, version: int) -> DataFrame:
        """version, generico, ponderador, encadenamiento and the classification columns."""


class SeriesReader(Protocol):
    def __call__(self, spark: SparkSession, path: str, version: int) -> DataFrame:
        """version, generico, ord, valor."""


class OfficialSource(Protocol):
    def history(self, periodicity: str, measure: str) -> DataFrame:
        """tipo, indice, ord, oficial of all published periods; null where there is a gap."""

    def at(self, periods: DataFrame, periodicity: str, measure: str) -> DataFrame:
        """The same at some periods (ord)."""
