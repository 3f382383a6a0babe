"""Lenient coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grades import lookup

# Fixed values.
MATERIALITY = {"material": 3, "notable": 2, "standard": 1}
SENSITIVITY = {"low": 1, "medium": 2, "high": 3, "sensitive": 4}
SENSITIVITY_RISK = {"low": 2, "medium": 5, "high": 7, "sensitive": 8}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "MMMM yyyy", "yyyy-MM", "yyyy")


def yes_no_unclear(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("yes", "true", "1"), "yes").when(v.isin("no", "false", "0"), "no").when(v.isin("unclear", "unknown", "null", "none", ""), "unclear")


def boolean(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "1", "y", "on"), True).when(v.isin("false", "no", "0", "n", "off", ""), False)


def rank(value: Column, order: dict[str, int]) -> Column:
    return lookup(F.lower(F.trim(value)), order, 0)


def parse_date(text: Column, first: int = 2000, last: int = 2030) -> Column:
    """A date in one of several formats within the years; month names in any case."""
    plain = F.initcap(F.lower(F.trim(text)))
    found = F.coalesce(*[F.try_to_date(plain, f) for f in DATE_FORMATS])
    return F.when(F.year(found).between(first, last), found)
