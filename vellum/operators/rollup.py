"""Findings of documents rolled up to products: items, conflicts, coverage, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.functions.coerce import MATERIALITY, rank

CONFLICTABLE = ("data_sale", "retention", "ai_training", "breach_notification", "children")
MOST_ATTRIBUTES = 50
KEY = ["product_id", "category", "normalized_value"]


def in_order(value: str, seq: str = "seq") -> Column:
    """The values of a group in the order of seq."""
    return F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value])


def items(findings: DataFrame) -> DataFrame:
    """One row for each product, category and normalised value: the first value, the documents in order of appearance, and attributes.

    Documents repeat within a group, so each one's first appearance is found before they are gathered.
    """
    per_document = findings.groupBy(*KEY, "document_id").agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"), F.count("materiality").alias("n_attributes"))
    return per_document.groupBy(*KEY).agg(F.min_by("value", "seq").alias("value"), in_order("document_id").alias("document_ids"), F.sum("n_attributes").alias("n_attributes"))


def first_items(findings: DataFrame) -> DataFrame:
    """One row for each product, category and normalised value: the first value and its place. One aggregate, without documents."""
    return findings.groupBy(*KEY).agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))


def aggregated(findings: DataFrame) -> DataFrame:
    """As items, but documents stay with their repetitions and evidence is summed."""
    return findings.groupBy(*KEY).agg(F.min_by("value", "seq").alias("value"), in_order("document_id").alias("documents"), F.sum("evidence").alias("n_evidence"))


def item_documents(findings: DataFrame) -> DataFrame:
    """The documents of each item, a row each with the place of its first appearance: an item of a large product is no single row."""
    return findings.groupBy(*KEY, "document_id").agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"), F.count("materiality").alias("n_attributes"), F.sum("evidence").alias("n_evidence"))


def item_totals(documents: DataFrame) -> DataFrame:
    """The first value of each item of item_documents and how many documents, attributes and spans of evidence it has."""
    return documents.groupBy(*KEY).agg(F.min_by("value", "seq").alias("value"), F.count("*").alias("n_documents"), F.sum("n_attributes").alias("n_attributes"), F.sum("n_evidence").alias("n_evidence"))


def children_key(value: Column) -> Column:
    """allowed or restricted for statements about children; other values as they are."""
    age = F.regexp_extract(value, r"minimum age:\s*([0-9]+)", 1)
    return F.when(value == "children_data_collection:no", "restricted").when(value == "children_data_collection:yes", "allowed").when(age != "", F.when(age.cast("int") >= 18, "restricted").otherwise("allowed")).otherwise(value)


def conflicts(findings: DataFrame) -> DataFrame:
    """Categories in which a product's documents state different things."""
    key = F.when(F.col("category") == "children", children_key(F.col("normalized_value"))).otherwise(F.col("normalized_value"))
    few = findings.where(F.col("category").isin(*CONFLICTABLE)).select("product_id", "category", key.alias("key"), "document_id").distinct()
    return few.groupBy("product_id", "category").agg(F.countDistinct("key").alias("n_values"), F.countDistinct("document_id").alias("n_documents")).where("n_values > 1")


def coverage(findings: DataFrame, products: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """The status of every required category for every product: found, missing, or not_analyzed without documents."""
    needed = products.select("product_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    have = findings.select("product_id", "category").distinct().withColumn("found", F.lit(True))
    any_ = findings.select("product_id").distinct().withColumn("analyzed", F.lit(True))
    status = F.when(F.col("analyzed").isNull(), "not_analyzed").when(F.col("found"), "found").otherwise("missing")
    return needed.join(have, ["product_id", "category"], "left").join(any_, "product_id", "left").select("product_id", "category", status.alias("status"))


def clean_clusters(clusters: list, count: int) -> list[list[int]]:
    """Groups of indices from an outside judge: unknown and repeated indices go, those left out stand alone."""
    seen: set[int] = set()
    out = []
    for group in clusters:
        own = [i for i in dict.fromkeys(group) if isinstance(i, int) and 0 <= i < count and i not in seen]
        seen.update(own)
        out += [own] if own else []
    return out + [[i] for i in range(count) if i not in seen]


def cluster(rollup: DataFrame, judge: Callable[[str, list[str]], list[list[int]]]) -> DataFrame:
    """Numbers the clusters of each product and category by a judge; where it raises, every item stands alone.

    A task goes through its groups in order and holds one batch and the group at its end: a call of Python for each
    group would cost milliseconds. Other columns pass as they are.
    """

    def numbers(category: str, values: list[str]) -> list[int]:
        try:
            groups = clean_clusters(judge(category, values), len(values))
        except Exception:  # an outside judge: whatever it raises, no item is lost
            groups = [[i] for i in range(len(values))]
        place = {i: k for k, g in enumerate(groups) for i in g}
        return [place[i] for i in range(len(values))]

    def numbered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out: list[int] = []
        keys = zip(rows["product_id"].to_pylist(), rows["category"].to_pylist(), rows["value"].to_pylist())
        for (_, category), own in groupby(keys, key=lambda x: x[:2]):
            out += numbers(category, [value for *_, value in own])
        yield from rows.append_column("cluster", pa.array(out, pa.int32())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            products, categories = rows["product_id"], rows["category"]
            last, start = (products[-1], categories[-1]), rows.num_rows - 1
            while start and (products[start - 1], categories[start - 1]) == last:
                start -= 1
            if held and (start or (held[0]["product_id"][0], held[0]["category"][0]) != last):
                yield from numbered(pa.concat_tables([*held, rows.slice(0, start)]).combine_chunks())
                held = []
            elif start:
                yield from numbered(rows.slice(0, start))
            held.append(rows.slice(start))
        if held:
            yield from numbered(pa.concat_tables(held).combine_chunks())

    kept = rollup.select("product_id", "category", "value", "seq", *[c for c in ("document_ids",) if c in rollup.columns])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", cluster int"
    return kept.repartition("product_id", "category").sortWithinPartitions("product_id", "category", "seq").mapInArrow(run, schema)


def merge_clusters(clustered: DataFrame) -> DataFrame:
    """One item for each cluster: its longest value (the first of those), all documents in order if given, all normalised values."""
    keys = ["product_id", "category", "cluster"]
    flat = [F.array_distinct(F.flatten(in_order("document_ids"))).alias("document_ids")] if "document_ids" in clustered.columns else []
    members = F.array_distinct(F.transform(in_order("value"), text.normalize_value))
    return clustered.groupBy(*keys).agg(F.max_by("value", F.struct(F.length("value"), -F.col("seq"))).alias("value"), *flat, members.alias("member_values"))


def strongest_attributes(findings: DataFrame, most: int = MOST_ATTRIBUTES) -> DataFrame:
    """Distinct attributes of each item, material ones first, at most so many."""
    levels = findings.where("materiality is not null").select(*KEY, "materiality", rank(F.col("materiality"), MATERIALITY).alias("rank")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rank"), "materiality"))), lambda x: x["materiality"])
    return levels.groupBy(*KEY).agg(F.slice(ordered, 1, most).alias("attributes"))


def keypoint_evidence(points: DataFrame, evidence: DataFrame, most: int = 3) -> DataFrame:
    """(document_id, keypoint, seq, place): the first spans of evidence (document_id, value, seq) whose value a key point of the document holds, whatever its case."""
    held = points.join(evidence, "document_id").where(F.lower("keypoint").contains(F.lower(F.trim("value"))) & (F.trim("value") != ""))
    order = W.partitionBy("document_id", "keypoint").orderBy("seq")
    return held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("document_id", "keypoint", "seq", "place")
