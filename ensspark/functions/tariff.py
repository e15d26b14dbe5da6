"""Tariff rules as predicates over the columns of a goods item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ensspark.functions.values import blank


def digit_count(code: Column) -> Column:
    return F.length(F.regexp_replace(code, "[^0-9]", ""))


def current_code(tariff: Column, harmonized: Column) -> Column:
    """The code an item carries: tariff number first, else the harmonized heading."""
    return F.coalesce(tariff, harmonized)


def six_digits(code: Column) -> Column:
    """Batch rule: six digits whatever else is in the text; missing is invalid."""
    return F.coalesce(digit_count(code) == 6, F.lit(False))


def scan_ok(code: Column) -> Column:
    """Scan rule: as the batch rule, and blank text is invalid too."""
    return ~blank(code) & six_digits(code)


def six_long(code: Column) -> Column:
    """Conversion rule: exactly six characters of any kind."""
    return F.coalesce(F.length(code) == 6, F.lit(False))


def correction_ok(code: Column) -> Column:
    """A typed-in correction has to be exactly six digits."""
    return F.coalesce(F.trim(code).rlike("^[0-9]{6}$"), F.lit(False))
