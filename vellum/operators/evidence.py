"""Evidence and citations: cleaning, ranking, hydration of rollups, topic reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_CITATIONS = 5


def quote_key(quote: Column) -> Column:
    """Quotes that differ in case, spelling of licence, white space, quotation marks or final punctuation are one."""
    out = F.regexp_replace(F.lower(quote), "[\"'“”‘’]", "")
    out = F.regexp_replace(F.replace(out, F.lit("licence"), F.lit("license")), r"\s+", " ")
    return F.regexp_replace(F.trim(out), r"[\s.,;:!?]+$", "")


def distinct_citations(citations: DataFrame, keys: list[str]) -> DataFrame:
    """One citation for each document and quote within keys: the first by seq."""
    named = citations.withColumn("quote_key", quote_key(F.col("quote"))).where("quote_key <> ''")
    return named.groupBy(*keys, "document_id", "quote_key").agg(F.min_by(F.struct("quote", "verified", "section", "seq"), "seq").alias("c")).select(*keys, "document_id", "c.*")


def best(citations: DataFrame, keys: list[str], most: int = MOST_CITATIONS) -> DataFrame:
    """The first citations of each group: verified ones, then by document, section and quote."""
    order = W.partitionBy(*keys).orderBy(F.desc("verified"), "document_id", F.coalesce("section", F.lit("")), "quote", "seq")
    return citations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hydrate(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(product_id, category, value, n_evidence): stored items with the evidence of the findings they name.

    Items list documents and member values; both explode to equi-keys.
    """
    keyed = items.select("product_id", "category", "value", F.explode("member_values").alias("normalized_value"), "document_ids")
    keyed = keyed.select("product_id", "category", "value", "normalized_value", F.explode("document_ids").alias("document_id"))
    own = findings.groupBy("product_id", "category", "normalized_value", "document_id").agg(F.sum("evidence").alias("evidence"))
    return keyed.join(own, ["product_id", "category", "normalized_value", "document_id"], "left").groupBy("product_id", "category", "value").agg(F.coalesce(F.sum("evidence"), F.lit(0)).alias("n_evidence"))


def hydrate_documents(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """As hydrate, for items whose documents are rows (rollup.item_documents) with the item's value."""
    keys = ["product_id", "category", "normalized_value", "document_id"]
    own = findings.groupBy(*keys).agg(F.sum("evidence").alias("evidence"))
    return documents.select(*keys, "value").join(own, keys, "left").groupBy("product_id", "category", "value").agg(F.coalesce(F.sum("evidence"), F.lit(0)).alias("n_evidence"))


def contained_quotes(quotes: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Quotes with whether an allowed quote of the same key contains them; keys make it an equi-join."""
    a = allowed.select(key, F.col("quote").alias("by"))
    hit = quotes.join(a, key).where(F.contains("by", "quote")).select(key, "quote").distinct().withColumn("ok", F.lit(True))
    return quotes.join(hit, [key, "quote"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
