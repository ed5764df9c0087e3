"""Half months (Q) and months (M) as ordinals: a half month is year * 24 + (month - 1) * 2 + (half - 1), a month year * 12 + (month - 1)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvariantBroken, PeriodUnreadable

#: Month names in period texts.
MONTHS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
#: Periods back to the base of each frequency.
LAGS = {
    "Q": {"quincenal": 1, "mensual": 2, "bimestral": 4, "trimestral": 6, "cuatrimestral": 8, "semestral": 12, "anual": 24},
    "M": {"mensual": 1, "bimestral": 2, "trimestral": 3, "cuatrimestral": 4, "semestral": 6, "anual": 12},
}
PER_YEAR = {"Q": 24, "M": 12}
_MONTH_NUMBER = {m.lower(): i for i, m in enumerate(MONTHS)}


def parse(text: str) -> tuple[str, int]:
    """(periodicity, ordinal) of `1Q Ene 2024` or `Ene 2024`; case and spacing of the month don't matter."""
    parts = text.split()
    half = None
    if len(parts) == 3:
        if not re.fullmatch(r"[0-9]+[Qq]", parts[0]):
            raise PeriodUnreadable(f"no half month: {text!r}")
        half, parts = int(parts[0][:-1]), parts[1:]
    if len(parts) != 2 or parts[0].lower() not in _MONTH_NUMBER or not re.fullmatch(r"-?[0-9]+", parts[1]):
        raise PeriodUnreadable(f"no period: {text!r}")
    year, month = int(parts[1]), _MONTH_NUMBER[parts[0].lower()]
    if year < 1 or (half is not None and half not in (1, 2)):
        raise InvariantBroken(f"period out of range: {text!r}")
    return ("M", year * 12 + month) if half is None else ("Q", year * 24 + month * 2 + half - 1)


def parse_as(text: str, periodicity: str) -> int:
    found, ordinal = parse(text)
    if found != periodicity:
        raise InvariantBroken(f"{text!r} is not of periodicity {periodicity}")
    return ordinal


def text_of(ordinal: int, periodicity: str) -> str:
    if periodicity == "Q":
        return f"{ordinal % 2 + 1}Q {MONTHS[ordinal % 24 // 2]} {ordinal // 24}"
    return f"{MONTHS[ordinal % 12]} {ordinal // 12}"


def half_of_date(date: Column) -> Column:
    """The half month of a date; days up to 15 are in the first half."""
    return F.year(date) * 24 + (F.month(date) - 1) * 2 + F.when(F.dayofmonth(date) > 15, 1).otherwise(0)


def parse_column(text: Column, periodicity: str) -> Column:
    """The ordinal, or null for a text that is no such period; the same texts as `parse` reads."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    at = 1 if periodicity == "Q" else 0
    names = F.create_map(*(x for m, i in _MONTH_NUMBER.items() for x in (F.lit(m), F.lit(i))))
    month = F.try_element_at(names, F.lower(F.get(parts, F.lit(at))))
    digits = F.get(parts, F.lit(at + 1))
    year = F.when(digits.rlike(r"^[0-9]+$"), digits.try_cast("int"))
    year = F.when(year >= 1, year)
    whole = F.size(parts) == at + 2
    if periodicity == "M":
        return F.when(whole, year * 12 + month)
    half = F.regexp_extract(F.get(parts, F.lit(0)), r"^0*([12])[Qq]$", 1).try_cast("int")
    return F.when(whole, year * 24 + month * 2 + half - 1)


def text_column(ordinal: Column, periodicity: Column) -> Column:
    name = lambda i: F.element_at(F.array(*map(F.lit, MONTHS)), (i + 1).cast("int"))
    half = F.concat((ordinal % 2 + 1).cast("int").cast("string"), F.lit("Q "), name(F.floor(ordinal % 24 / 2)), F.lit(" "), F.floor(ordinal / 24).cast("string"))
    month = F.concat(name(ordinal % 12), F.lit(" "), F.floor(ordinal / 12).cast("string"))
    return F.when(periodicity == "Q", half).otherwise(month)


def date_column(ordinal: Column, periodicity: Column) -> Column:
    """Day 15 of a first half month, else the last day of the month."""
    year = lambda n: F.floor(ordinal / n).cast("int")
    half = F.make_date(year(24), F.floor(ordinal % 24 / 2).cast("int") + 1, F.lit(15))
    month = F.make_date(year(12), (ordinal % 12).cast("int") + 1, F.lit(15))
    return F.when(periodicity == "Q", F.when(ordinal % 2 == 0, half).otherwise(F.last_day(half))).otherwise(F.last_day(month))


def december_before(ordinal: Column, periodicity: str) -> Column:
    """The last period of the year before."""
    n = PER_YEAR[periodicity]
    return F.floor(ordinal / n).cast("int") * n - 1


def lag_of(frequency: str, periodicity: str) -> int:
    try:
        return LAGS[periodicity][frequency]
    except KeyError:
        raise InvariantBroken(f"frequency {frequency!r} is none of {sorted(LAGS.get(periodicity, {}))}") from None
