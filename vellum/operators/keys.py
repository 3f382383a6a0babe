"""Keys under which items of extractions count as the same thing."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import normalize_value

# Names and what they are filed under.
SYNONYMS = {
    "e-mail": "email", "e-mail address": "email address", "ip-address": "ip address", "phone number": "phone number", "telephone number": "phone number", "mobile number": "phone number",
    "date of birth": "date of birth", "birth date": "date of birth", "geolocation": "location", "geo-location": "location", "gps location": "location", "precise location": "location",
    "full name": "name", "first name": "name", "last name": "name", "firstname": "name", "lastname": "name", "given name": "name", "family name": "name", "forename": "name", "surname": "name",
    "user name": "username", "biometric data": "biometrics", "biometric information": "biometrics", "facial recognition data": "biometrics", "health data": "health information", "medical information": "health information",
    "genetic data": "genetic information", "financial information": "financial data", "payment information": "payment data", "credit card": "payment data", "debit card": "payment data", "billing info": "payment data",
    "billing information": "payment data", "device id": "device identifier", "device information": "device identifier", "unique device identifier": "device identifier", "advertising id": "ad identifier",
    "ad identifier": "ad identifier", "idfa": "ad identifier", "login info": "account credentials", "login information": "account credentials", "account credentials": "account credentials",
    "social security number": "ssn", "national id": "government id", "passport number": "government id", "drivers license": "government id", "driver's license": "government id", "purchase history": "transaction data",
    "transaction history": "transaction data", "shopping history": "transaction data", "browsing history": "usage data", "search history": "usage data", "viewing history": "usage data", "watch history": "usage data",
    "click stream": "usage data", "clickstream": "usage data",
}
CUTOFF = 0.85
BY_LENGTH = sorted(SYNONYMS, key=len, reverse=True)


def close_key(name: str, cutoff: float = CUTOFF) -> str:
    """The key of a normalised name: filed exactly, filed under a close spelling, or itself."""
    if name in SYNONYMS:
        return SYNONYMS[name]
    near = difflib.get_close_matches(name, BY_LENGTH, n=1, cutoff=cutoff) if len(name) < 60 else []
    return SYNONYMS[near[0]] if near else name


def with_keys(rows: DataFrame, column: str) -> DataFrame:
    """Adds key. Only distinct names that no exact rule files reach Python, so repeated ones cost one comparison."""

    @F.pandas_udf("string")
    def close(names: pd.Series) -> pd.Series:
        return names.map(close_key)

    named = rows.withColumn("_name", normalize_value(F.col(column)))
    exact = F.create_map(*[F.lit(x) for p in SYNONYMS.items() for x in p])
    filed = named.withColumn("_exact", exact[F.col("_name")])
    rest = filed.where("_exact is null").select("_name").distinct().withColumn("_close", close("_name"))
    return filed.join(rest, "_name", "left").withColumn("key", F.coalesce("_exact", "_close")).drop("_name", "_exact", "_close")
