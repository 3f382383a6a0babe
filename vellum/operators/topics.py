"""Stances of products on topics, and risk composed of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.grades import lookup

# Fixed values.
TOPIC_WEIGHTS = {"data_collection": 0.16, "data_sharing": 0.16, "ai_training": 0.16, "data_sale": 0.14, "user_rights": 0.12, "retention": 0.10, "security": 0.09, "cookies_tracking": 0.07}
OTHER_WEIGHT = 0.05
SEVERITY = {"harmful": 9, "conflicting": 7, "concerning": 6, "fair": 2}
PROTECTIVE = ("benefits", "security", "user_rights", "breach_notification")
ENOUGH_CITATIONS = 3


def counts(findings: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Findings, evidence, documents and conflicts of each product's topics."""
    found = findings.groupBy("product_id", "category").agg(F.count("*").alias("finding_count"), F.sum("evidence").alias("evidence_count"), F.countDistinct("document_id").alias("document_count"))
    against = conflicts.groupBy("product_id", "category").agg(F.count("*").alias("conflict_count"))
    return found.join(against, ["product_id", "category"], "left").withColumn("conflict_count", F.coalesce("conflict_count", F.lit(0)))


def stance_of(signal: Column) -> Column:
    return F.when(signal <= 3, "fair").when(signal <= 6, "concerning").otherwise("harmful")


def stances(coverage: DataFrame, counted: DataFrame, signals: DataFrame) -> DataFrame:
    """Status, stance and rationale of each product's topics.

    signals: (product_id, category, signal) integers whose rounded mean gives the stance. Fewer than ENOUGH_CITATIONS
    pieces of evidence make a topic fair; conflicts override; silence is no stance.
    """
    mean = signals.groupBy("product_id", "category").agg(F.bround(F.avg("signal")).cast("int").alias("signal"))
    keys = ["product_id", "category"]
    all_ = coverage.join(counted, keys, "left").join(mean, keys, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(n("conflict_count") > 0, "ambiguous").when(n("finding_count") > 0, "found").when(F.col("status") == "not_analyzed", "not_disclosed").otherwise(F.col("status"))
    silent = status.isin("missing", "not_disclosed")
    thin = n("evidence_count") < ENOUGH_CITATIONS
    raw = F.when(F.col("signal").isNotNull(), stance_of(F.col("signal"))).otherwise("concerning")
    stance = F.when(silent, "not_disclosed").when(status == "ambiguous", "conflicting").when(thin, "fair").otherwise(raw)
    positive = (stance == "fair") & F.col("category").isin(*PROTECTIVE)
    rationale = F.when(silent, "topic.not_disclosed").when(status == "ambiguous", "topic.conflicts_found").when(thin, "topic.thin_evidence").when(positive, "topic.positive_practice").otherwise("topic.findings_summary")
    return all_.select(*keys, status.alias("status"), stance.alias("stance"), rationale.alias("rationale_key"), *[n(c).alias(c) for c in ("finding_count", "evidence_count", "document_count", "conflict_count")])


def rationale_text(rows: DataFrame) -> DataFrame:
    """Adds the sentence of each rationale."""
    c = lambda name: F.col(name).cast("string")
    sentence = (
        F.when(F.col("rationale_key") == "topic.not_disclosed", "Topic is not disclosed in analyzed documents.")
        .when(F.col("rationale_key") == "topic.conflicts_found", F.concat(c("conflict_count"), F.lit(" conflict(s) found across "), c("document_count"), F.lit(" document(s).")))
        .when(F.col("rationale_key") == "topic.positive_practice", "Documents describe clear protective practices for this topic.")
        .when(F.col("rationale_key") == "topic.thin_evidence", F.concat(F.lit("Only "), c("evidence_count"), F.lit(" substantive citation(s) support this topic, so risk is treated as low until more evidence appears.")))
        .otherwise(F.concat(c("finding_count"), F.lit(" finding(s) across "), c("document_count"), F.lit(" document(s) with "), c("evidence_count"), F.lit(" evidence span(s).")))
    )
    return rows.withColumn("rationale", sentence)


def weighted(score: Column, weight: Column) -> Column:
    """The weighted mean of a group, halves rounded to even; weights are hundredths, so sums are exact."""
    w = F.bround(weight * 100).cast("long")
    return F.bround(F.sum(score * w) / F.sum(w)).cast("int")


def product_risk(rows: DataFrame) -> DataFrame:
    """Risk from 0 to 10 of each product: weighted severity of its stances, silence left out, 5 without any."""
    severity = lookup(F.col("stance"), SEVERITY)
    weight = lookup(F.col("category"), TOPIC_WEIGHTS, OTHER_WEIGHT)
    spoken = rows.withColumn("severity", F.when(~F.col("status").isin("missing", "not_disclosed"), severity)).withColumn("weight", F.when(F.col("severity").isNotNull(), weight))
    risk = F.coalesce(weighted(F.col("severity"), F.col("weight")), F.lit(5))
    return spoken.groupBy("product_id").agg(F.greatest(F.lit(0), F.least(F.lit(10), risk)).alias("risk"))
