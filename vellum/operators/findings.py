"""Extractions of documents turned into findings: one projection for each field, joined by union.

An extraction row has product_id, document_id and array columns of structs; a field that a table lacks is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import normalize_value

TEXT_FIELDS = ("security", "consent_mechanisms", "account_lifecycle", "indemnification", "termination_consequences", "dangers", "benefits", "recommended_actions")
SIGNALS = {"data_sale": "data_sale", "cookies": "cookies_tracking", "ai_training_on_user_data": "ai_training", "breach_notification": "breach_notification", "children_data_collection": "children"}


def struct_field(name: str) -> Column:
    return F.col(f"x.{name}")


def said(name: str) -> Column:
    return F.trim(F.coalesce(struct_field(name), F.lit(""))) != ""


#: Field -> (category, value, key); a null key means the normalised value.
FIELDS = {
    "data_collected": ("data_collection", lambda: struct_field("data_type"), None),
    "data_purposes": ("data_purposes", lambda: struct_field("data_type"), None),
    "third_party_details": ("data_sharing", lambda: struct_field("recipient"), None),
    "international_transfers": ("international_transfers", lambda: struct_field("destination"), None),
    "government_access": ("government_access", lambda: F.when(said("authority_type"), F.concat(F.trim(struct_field("authority_type")), F.lit(": "), F.trim(F.coalesce(struct_field("conditions"), F.lit(""))))), lambda: F.concat(struct_field("authority_type"), F.lit(":"), F.coalesce(struct_field("conditions"), F.lit("")))),
    "corporate_family_sharing": ("corporate_family_sharing", lambda: F.array_join(struct_field("entities"), ", "), lambda: F.array_join(struct_field("entities"), ",")),
    "user_rights": ("user_rights", lambda: struct_field("right_type"), None),
    "liability": ("liability", lambda: struct_field("description"), None),
    "content_ownership": ("content_ownership", lambda: struct_field("description"), None),
    "scope_expansion": ("scope_expansion", lambda: struct_field("description"), None),
    "dispute_resolution": ("dispute_resolution", lambda: F.when(said("mechanism"), F.trim(F.coalesce(F.nullif(struct_field("description"), F.lit("")), struct_field("mechanism")))), lambda: struct_field("mechanism")),
    "retention_policies": ("retention", lambda: F.concat(struct_field("data_scope"), F.lit(": "), F.coalesce(struct_field("duration"), F.lit(""))), lambda: struct_field("data_scope")),
    "cookies_and_trackers": ("cookies_tracking", lambda: struct_field("name_or_type"), None),
    **{f: (f, lambda: struct_field("value"), None) for f in TEXT_FIELDS},
}


def of_field(extractions: DataFrame, field: str) -> DataFrame:
    category, value, key = FIELDS[field]
    rows = extractions.select("product_id", "document_id", F.posexplode(field).alias("pos", "x"))
    made = rows.select("product_id", "document_id", "pos", F.lit(category).alias("category"), value().alias("value"), *([F.col("x.materiality").alias("materiality")] if field in TEXT_FIELDS else [F.lit("notable" if field == "dispute_resolution" else None).cast("string").alias("materiality")]), normalize_value(key() if key else value()).alias("normalized_value"))
    made = made.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return made.where("materiality is null or materiality = 'material'") if field == "dangers" else made


def of_ai_usage(extractions: DataFrame) -> DataFrame:
    rows = extractions.select("product_id", "document_id", F.posexplode("ai_usage").alias("pos", "x")).where(said("usage_type"))
    category = F.when(struct_field("usage_type") == "training_on_user_data", "ai_training").otherwise("automated_decisions")
    value = F.trim(F.coalesce(F.nullif(F.trim(struct_field("description")), F.lit("")), struct_field("usage_type")))
    key = F.concat(struct_field("usage_type"), F.lit(":"), F.coalesce(struct_field("description"), F.lit("")))
    return rows.select("product_id", "document_id", "pos", category.alias("category"), value.alias("value"), F.lit(None).cast("string").alias("materiality"), normalize_value(key).alias("normalized_value"))


def of_signals(extractions: DataFrame) -> DataFrame:
    """Only yes and no are statements."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("name"), F.col(f"privacy_signals.{s}").alias("v")) for s, c in SIGNALS.items()])
    rows = extractions.select("product_id", "document_id", F.posexplode(pairs).alias("pos", "x")).where("x.v in ('yes', 'no')")
    return rows.select("product_id", "document_id", "pos", F.col("x.category").alias("category"), F.concat("x.name", F.lit(": "), "x.v").alias("value"), F.lit(None).cast("string").alias("materiality"), F.concat("x.name", F.lit(":"), "x.v").alias("normalized_value"))


def of_children(extractions: DataFrame) -> DataFrame:
    """What a document says of children: age, consent and protections together, nothing where all are left open."""
    c = lambda name: F.col(f"children_policy.{name}")
    parts = F.array_compact(F.array(F.concat(F.lit("Minimum age: "), c("minimum_age").cast("string")), F.when(c("parental_consent_required"), "Parental consent required"), F.nullif(c("special_protections"), F.lit(""))))
    rows = extractions.select("product_id", "document_id", F.lit(0).alias("pos"), F.array_join(parts, "; ").alias("value")).where("value <> ''")
    return rows.select("product_id", "document_id", "pos", F.lit("children").alias("category"), "value", F.lit(None).cast("string").alias("materiality"), normalize_value(F.col("value")).alias("normalized_value"))


def of_extractions(extractions: DataFrame) -> DataFrame:
    """All findings of all fields that the table has."""
    parts = [of_field(extractions, f) for f in FIELDS if f in extractions.columns]
    parts += [of_ai_usage(extractions)] if "ai_usage" in extractions.columns else []
    parts += [of_signals(extractions)] if "privacy_signals" in extractions.columns else []
    parts += [of_children(extractions)] if "children_policy" in extractions.columns else []
    return reduce(DataFrame.unionByName, parts)
