"""Merging items of a document's chunks by key: one aggregate for each policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import normalize_value


def strongest(value: str, order: dict[str, int], seq: str) -> Column:
    """The value of the highest rank, the first among equals."""
    rank = F.create_map(*[F.lit(x) for p in order.items() for x in p])[F.col(value)]
    return F.max_by(value, F.struct(F.coalesce(rank, F.lit(0)), -F.col(seq)))


def longest(value: str, seq: str) -> Column:
    """The longest value, the first among equals."""
    return F.max_by(value, F.struct(F.length(value), -F.col(seq)))


def first(value: str, seq: str) -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))


def last_valid(value: str, seq: str, valid: tuple[str, ...]) -> Column:
    """The last value that is one of valid."""
    return F.max_by(value, F.when(F.col(value).isin(*valid), F.col(seq)))


def sticky(flag: Column) -> Column:
    """Once true, true."""
    return F.coalesce(F.bool_or(flag), F.lit(False))


def union(value: str, seq: str) -> Column:
    """Distinct values in order of appearance; the input should hold each value once a key."""
    return F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value])


def signal(value: Column) -> Column:
    """yes before no before unclear."""
    return F.when(F.bool_or(value == "yes"), "yes").when(F.bool_or(value == "no"), "no").otherwise("unclear")


def flat_union(value: str, seq: str) -> Column:
    """Distinct elements of arrays in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value])))


def largest(value: str, seq: str) -> Column:
    return F.max(value)


def any_true(value: str, seq: str) -> Column:
    return sticky(F.col(value))


def by_rank(order: dict[str, int]):
    return lambda value, seq: strongest(value, order, seq)


def one_of(valid: tuple[str, ...]):
    return lambda value, seq: last_valid(value, seq, valid)


def answered(value: str, seq: str) -> Column:
    return signal(F.col(value))


MATERIALITY = {"standard": 1, "notable": 2, "material": 3}
SENSITIVITY = {"low": 1, "medium": 2, "high": 3, "sensitive": 4}
REQUIRED = {"unclear": 1, "optional": 2, "required": 3}

#: How each field's attributes merge when chunks of a document state the same key.
POLICIES = {
    "text_items": {"value": first, "materiality": by_rank(MATERIALITY)},
    "data_collected": {"data_type": first, "sensitivity": by_rank(SENSITIVITY), "required": by_rank(REQUIRED)},
    "data_purposes": {"data_type": first, "purposes": flat_union},
    "retention_policies": {"data_scope": first, "duration": longest, "conditions": first},
    "cookies_and_trackers": {"name_or_type": first, "category": first, "third_party": any_true, "opt_out_mechanism": first},
    "third_party_details": {"recipient": first, "data_shared": flat_union, "purpose": longest, "risk_level": one_of(("low", "medium", "high"))},
    "international_transfers": {"destination": first, "mechanism": first, "data_types": flat_union},
    "government_access": {"authority_type": first, "conditions": first, "data_scope": first},
    "corporate_family_sharing": {"entities": first, "data_shared": flat_union, "purpose": first},
    "user_rights": {"right_type": first, "mechanism": first, "description": longest},
    "ai_usage": {"usage_type": first, "description": first, "data_involved": flat_union, "opt_out_available": answered, "consequences": first},
    "children_policy": {"minimum_age": largest, "parental_consent_required": any_true, "special_protections": longest},
    "liability": {"scope": first, "limitation_type": first, "description": first, "extends_beyond_product": any_true},
    "dispute_resolution": {"mechanism": first, "class_action_waiver": any_true, "jury_trial_waiver": any_true, "venue": first, "governing_law": first, "description": first},
    "content_ownership": {"ownership_type": first, "scope": first, "description": first},
    "scope_expansion": {"scope_type": first, "description": first, "entities_affected": flat_union},
    "privacy_signals": {"data_sale": answered, "cookies": answered, "ai_training_on_user_data": answered, "breach_notification": answered, "children_data_collection": answered},
}


#: Kinds that a field knows, and the one that stands for others.
KINDS = {
    "liability": ("limitation_type", ("cap", "waiver", "exclusion", "indemnification"), "waiver"),
    "dispute_resolution": ("mechanism", ("arbitration", "litigation", "mediation", "other"), "other"),
    "content_ownership": ("ownership_type", ("license_to_company", "user_retains", "company_owns", "ai_training_rights", "likeness_rights", "other"), "other"),
    "scope_expansion": ("scope_type", ("cross_entity", "survival_clause", "unilateral_modification", "binding_heirs", "physical_world", "other"), "other"),
}
#: What tells items of a field apart, beside their kind.
PARTS = {
    "text_items": ("value",),
    "data_collected": ("data_type",),
    "data_purposes": ("data_type",),
    "retention_policies": ("data_scope",),
    "cookies_and_trackers": ("name_or_type",),
    "third_party_details": ("recipient",),
    "international_transfers": ("destination",),
    "government_access": ("authority_type", "conditions"),
    "user_rights": ("right_type",),
    "ai_usage": ("usage_type", "description"),
    "liability": ("scope",),
    "dispute_resolution": ("venue", "governing_law"),
    "content_ownership": ("scope",),
    "scope_expansion": ("description",),
}


def keyed(items: DataFrame, field: str) -> DataFrame:
    """A field's items with their key and a known kind; items whose key is empty go."""
    if field in KINDS:
        name, known, other = KINDS[field]
        kind = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
        items = items.withColumn(name, F.when(kind.isin(*known), kind).otherwise(other))
    if field == "corporate_family_sharing":
        key = F.when(F.size("entities") > 0, F.array_join(F.array_sort("entities"), ",")).otherwise(F.coalesce(F.nullif(F.col("purpose"), F.lit("")), F.lit("unnamed")))
    else:
        key = F.concat_ws(":", *([F.col(KINDS[field][0])] if field in KINDS else []), *[normalize_value(F.col(c)) for c in PARTS[field]])
    return items.withColumn("key", normalize_value(key)).where("key <> ''")


#: Rows of a task that merges, so that its tables of keys stay as they are when the input grows.
TASK_ROWS = 500_000


def dealt(items: DataFrame, by: str = "document_id", rows: int = TASK_ROWS) -> DataFrame:
    """items dealt by a key to tasks of about so many rows: merges by it, and by it and more, then need no other shuffle."""
    least = items.sparkSession.sparkContext.defaultParallelism
    return items.repartition(max(least, -(-items.count() // rows)), by)


def merge_field(items: DataFrame, field: str, keys: tuple[str, ...] = ("document_id", "key"), seq: str = "seq") -> DataFrame:
    """One row for each document and key of a field's items, by the field's policies; attributes the table lacks are left out."""
    policies = {c: p for c, p in POLICIES[field].items() if c in items.columns}
    return items.groupBy(*keys).agg(*[p(c, seq).alias(c) for c, p in policies.items()])
