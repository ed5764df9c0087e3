"""Text and number functions of the readers and extract tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Vowels without accents (ñ stays), no punctuation, single spaces, lower case. (?U) makes \\w cover all letters."""
    plain = F.translate(text, "áéíóúüÁÉÍÓÚÜ", "aeiouuAEIOUU")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")))


def without_number(text: Column) -> Column:
    """Without one leading number and the spaces after it."""
    return F.regexp_replace(text, r"^\d+\s+", "")


def code_of(text: Column) -> Column:
    """The leading code (digits and dots before a space); empty without one."""
    return F.regexp_extract(text, r"^([\d.]+)\s+(.*)$", 1)


def name_after_code(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\d.]+\s+", "")


def decimals(number: Column) -> Column:
    """Decimal places of a number's text, scientific notation included."""
    mantissa = F.length(F.regexp_extract(number, r"^[^.eE]*\.?(\d*)", 1))
    exponent = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), mantissa - exponent)


def round_half_even(value: Column, places: Column) -> Column:
    """Rounds a double to a number of places that may differ by row (0 to 15)."""
    scale = F.pow(F.lit(10.0), places)
    return F.rint(value * scale) / scale


def equal_when_rounded(a: Column, b: Column) -> Column:
    """Two numbers' texts agree at the places of the less precise one."""
    places = F.least(decimals(a), decimals(b))
    return round_half_even(a.try_cast("double"), places) == round_half_even(b.try_cast("double"), places)


def more_precise(a: Column, b: Column) -> Column:
    """The text with more decimals; the first of equals."""
    return F.when(decimals(b) > decimals(a), b).otherwise(a)
