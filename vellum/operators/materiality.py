"""How terms surface to consumers: tiers, severities, signals of topics, and guards of overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.grades import lookup

# Tiers, severities, and the risk that a label stands for.
STANDARD, NOTABLE, MATERIAL = "standard_industry", "notable", "material_risk"
SEVERITIES = ("critical", "high", "medium", "low")
SENSITIVITY_RISK = {"low": 2, "medium": 5, "high": 7, "sensitive": 8}
SHARING_RISK = {"low": 3, "medium": 6, "high": 8}
SILENT = ("missing", "not_disclosed")
PATHS = r"(?i)https?://|@|(?:settings?|account|profile|dashboard|in-app|preference)"
ACTIONS = r"(?i)disable|delete|opt[\s-]?out|request|revoke|contact|email|turn[\s-]?off|uncheck|unsubscribe|review|check"


def tier(text: Column, label: Column) -> Column:
    """A label's tier; without a known label, material unless the text is blank."""
    known = F.lower(F.trim(label))
    return F.when(known.isin(STANDARD, NOTABLE, MATERIAL), known).when(F.trim(F.coalesce(text, F.lit(""))) == "", STANDARD).otherwise(MATERIAL)


def excluded(text: Column, label: Column) -> Column:
    """Whether a term is none of the dangers."""
    return tier(text, label) != MATERIAL


def severity(given: Column, text: Column, label: Column) -> Column:
    """The severity of a case, lowered for routine terms; unknown ones are medium."""
    low, kind = F.lower(F.trim(F.coalesce(given, F.lit("")))), tier(text, label)
    return F.when(kind == STANDARD, "low").when((kind == NOTABLE) & low.isin("critical", "high"), "medium").when(low.isin(*SEVERITIES), low).otherwise("medium")


def watch_out(cases: DataFrame) -> DataFrame:
    """Cases (text, label, severity, classification) to watch out for: standard ones go, notable ones become informational."""
    kind = tier(F.col("text"), F.col("label"))
    said = F.lower(F.trim(F.coalesce("classification", F.lit(""))))
    calm = F.when(kind == NOTABLE, F.when(said.isin("blocker", "critical") | (F.coalesce("classification", F.lit("")) == ""), "informational").otherwise(F.col("classification"))).otherwise(F.col("classification"))
    kept = cases.where(kind != STANDARD)
    return kept.withColumns({"severity": F.when(kind == NOTABLE, severity(F.col("severity"), F.col("text"), F.col("label"))).otherwise(F.col("severity")), "classification": calm})


def by_tier(kind: Column, standard: int, notable: int, material: int) -> Column:
    return F.when(kind == STANDARD, standard).when(kind == NOTABLE, notable).otherwise(material)


def topic_signal(category: Column, value: Column, label: Column, n_documents: Column, sensitivity: Column, required: Column, risk: Column, third_party: Column, cookie: Column, has: Column) -> Column:
    """The risk from 0 to 10 that one finding signals for its topic; null for dangers that are none. has: whether attributes are known."""
    low, kind = F.lower(value), tier(value, label)
    answered = lambda name, yes, no, open_: F.when(low.contains(f"{name}: yes"), yes).when(low.contains(f"{name}: no"), no).otherwise(open_)
    shared = F.when(n_documents >= 2, 3).otherwise(4)
    cookies = F.greatest(F.when(third_party, 7).otherwise(5), F.when(F.lower(cookie) == "advertising", 8).otherwise(0))
    data = F.least(F.lit(10), lookup(F.lower(F.trim(sensitivity)), SENSITIVITY_RISK, 5) + F.when(F.lower(required) == "required", 1).otherwise(0))
    rules = {
        "data_sale": answered("sells_data", 9, 2, 6),
        "ai_training": answered("ai_training_on_user_data", 8, 3, 6),
        "breach_notification": answered("breach_notification", 3, 7, 5),
        "children": answered("children_data_collection", 8, 3, 6),
        "data_collection": F.when(has, data).otherwise(5),
        "data_sharing": F.when(has, lookup(F.lower(F.trim(risk)), SHARING_RISK, 6)).otherwise(6),
        "cookies_tracking": F.when(has, cookies).otherwise(6),
        "security": shared,
        "user_rights": shared,
        "government_access": F.lit(7),
        "liability": F.lit(7),
        "scope_expansion": F.lit(7),
        "indemnification": by_tier(kind, 3, 5, 7),
        "international_transfers": by_tier(kind, 3, 5, 7),
        "dispute_resolution": by_tier(kind, 4, 4, 6),
        "termination_consequences": by_tier(kind, 3, 5, 5),
        "content_ownership": by_tier(kind, 3, 5, 7),
        "dangers": F.when(kind == MATERIAL, 8),
        "benefits": F.lit(3),
    }
    first, *rest = rules.items()
    return reduce(lambda w, r: w.when(category == r[0], r[1]), rest, F.when(category == first[0], first[1])).otherwise(5)


def stance(score: Column) -> Column:
    return F.when(score <= 3, "fair").when(score <= 6, "concerning").otherwise("harmful")


def topic_stances(signals: DataFrame) -> DataFrame:
    """(product_id, category, signal, stance) of the mean signal of each topic, halves to even."""
    mean = F.bround(F.avg("signal")).cast("int")
    return signals.where("signal is not null").groupBy("product_id", "category").agg(mean.alias("signal")).withColumn("stance", stance(F.col("signal")))


def share(texts: Column, test) -> Column:
    """The part of an array's texts that pass a test; 1 of an empty array."""
    return F.when(F.size(texts) > 0, F.size(F.filter(texts, test)) / F.size(texts)).otherwise(1.0)


def overview_guards(o: DataFrame, words, long_sentences) -> DataFrame:
    """Adds the checks of an overview: headline, summary, grade, justification, adequate, rights, dangers, benefits, actions and stances (status, evidence_count).

    words, long_sentences: the counts of a text's words and of its sentences that are too long.
    """
    silent = F.size(F.filter("stances", lambda s: s["status"].isin(*SILENT))) / F.size("stances")
    evidence = F.aggregate("stances", F.lit(0), lambda n, s: n + F.coalesce(s["evidence_count"], F.lit(0)))
    on_silence = (F.size("stances") > 0) & (F.upper(F.trim(F.coalesce("grade", F.lit("")))) == "E") & (silent > 0.7) & (evidence == 0)
    path = lambda x: F.coalesce(x.rlike(PATHS), F.lit(False))
    reachable = lambda x: path(x) | F.coalesce(F.lower(x).contains("contact") | F.lower(x).contains("email the company"), F.lit(False))
    checks = {
        "headline_not_empty": ~F.col("adequate") | (F.trim(F.coalesce("headline", F.lit(""))) != ""),
        "no_e_grade_on_silence": ~F.coalesce(on_silence, F.lit(False)),
        "summary_length": words(F.coalesce("summary", F.lit(""))) <= 20,
        "headline_length": words(F.coalesce("headline", F.lit(""))) <= 25,
        "no_long_sentences": sum((long_sentences(x) for x in (F.coalesce("justification", F.lit("")), F.concat_ws(" ", "dangers"), F.concat_ws(" ", "benefits"))), F.lit(0)) == 0,
        "dangers_benefits_balance": (F.size("dangers") < 5) | (F.size("benefits") >= 2),
        "rights_have_paths": (share(F.col("rights"), path) >= 0.7) | (share(F.col("rights"), reachable) == 1.0),
        "actions_actionable": share(F.col("actions"), lambda x: path(x) | F.coalesce(x.rlike(ACTIONS), F.lit(False))) >= 0.7,
    }
    out = o.withColumns(checks)
    return out.withColumn("re_roll", ~(F.col("headline_not_empty") & F.col("no_e_grade_on_silence")))
