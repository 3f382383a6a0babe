"""Letter grades A to E, verdicts and risk scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
USER_SCORES = {"A": 9, "B": 7, "C": 5, "D": 3, "E": 1}
RISK_SCORES = {"A": 1, "B": 3, "C": 5, "D": 7, "E": 9}
VERDICTS = {"A": "very_user_friendly", "B": "user_friendly", "C": "moderate", "D": "pervasive", "E": "very_pervasive"}
DIMENSION_WEIGHTS = {"transparency": 0.14, "data_collection_scope": 0.26, "user_control": 0.18, "third_party_sharing": 0.24, "data_retention_score": 0.10, "security_score": 0.08}


def lookup(key: Column, values: dict, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def coerce(value: Column, default: str = "C") -> Column:
    letter = F.substring(F.upper(F.trim(value)), 1, 1)
    return F.when(letter.isin(*USER_SCORES), letter).otherwise(default)


def of_user_score(score: Column) -> Column:
    """A grade for a score from 0 to 10, higher better; halves round to even."""
    s = F.bround(score)
    return F.when(s >= 8, "A").when(s >= 6, "B").when(s >= 4, "C").when(s >= 2, "D").otherwise("E")


def of_risk_score(score: Column) -> Column:
    return F.when(score <= 2, "A").when(score <= 4, "B").when(score <= 6, "C").when(score <= 8, "D").otherwise("E")


def risk_score(grade: Column) -> Column:
    return lookup(grade, RISK_SCORES, 5)


def user_score(grade: Column) -> Column:
    return lookup(grade, USER_SCORES, 5)


def verdict(grade: Column) -> Column:
    return lookup(grade, VERDICTS, "moderate")


def clamp(proposed: Column, derived: Column, delta: int = 1) -> Column:
    """The proposed grade, within delta letters of the derived one; the derived one where either is no grade."""
    order = "ABCDE"
    place = lambda g: F.instr(F.lit(order), g)
    ok = proposed.isin(*order) & derived.isin(*order)
    at = F.least(F.greatest(place(proposed), place(derived) - delta), place(derived) + delta)
    return F.when(ok, F.substring(F.lit(order), at, F.lit(1))).otherwise(coerce(derived))
