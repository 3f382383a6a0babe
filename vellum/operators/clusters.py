"""Clusters of items by an outside judge, without a group that one task must hold."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.sources.sinks import settled

from . import scans
from .rollup import KEY, clean_clusters

# Categories whose items are prose, which may say one thing in several ways.
NARRATIVE = ("content_ownership", "dangers", "scope_expansion", "liability", "termination_consequences", "indemnification", "dispute_resolution", "benefits", "recommended_actions", "data_purposes")
#: Items that a judge is asked about at once.
BLOCK = 40
Judge = Callable[[str, list[str]], list[list[int]]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    Each round takes the neighbours' smallest label, then the label of the label, so rounds grow with the logarithm of
    the longest path; lineage is cut after each.
    """
    both = settled(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        next_ = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = next_.select(F.col("node").alias("label"), F.col("label").alias("far"))
        now = settled(next_.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = now.select("node", "label")
        if now.where("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def blocks(items: DataFrame, group: list[str], size: int) -> DataFrame:
    """items (group, id, value, n) with the block that they are judged in; a group of up to size items is one block.

    Items of a larger group meet by each word of their value: those of a word are put in order of their values, and each
    stands in two blocks of size, half a block apart, so neighbours always meet.
    """
    small = items.where(F.col("n") <= size).select(*group, "id", "value", F.lit("").alias("word"), F.lit(0).alias("range_"), F.lit(0).alias("slot"))
    words = F.array_distinct(F.filter(F.split(text.normalize_value(F.col("value")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    keyed = items.where(F.col("n") > size).select(*group, "id", "value", F.explode(words).alias("word"))
    order = ["value", "id"]
    by = F.struct(*group, "word")
    keyed = keyed.withColumn("by_", by)
    cut = keyed.withColumn("range_", F.lit(0)) if scans.largest(keyed, "by_") <= scans.MOST else scans.ranged(keyed, "by_", order)
    place = F.row_number().over(W.partitionBy(*group, "word", "range_").orderBy(*order)) - 1
    half = F.floor(place / max(1, size // 2)).cast("int")
    near = cut.withColumn("half_", half).select(*group, "id", "value", "word", "range_", F.explode(F.array("half_", F.col("half_") + 1)).alias("slot"))
    return small.unionByName(near)


def judged(items: DataFrame, group: list[str], judge: Judge, category: str, size: int = BLOCK) -> DataFrame:
    """(id, cluster) of items (group, id, value): the smallest id of those that blocks' judgements connect.

    A judge that raises leaves its block's items alone; unknown and repeated indices of its answer do not count. Items of
    groups with one item are not asked about.
    """
    counted = items.join(items.groupBy(*group).agg(F.count("*").alias("n")), group).where("n > 1")
    at = [*group, "word", "range_", "slot"]

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        try:
            groups = clean_clusters(judge(part[category][0], part["value"].tolist()), len(part))
        except Exception:  # an outside judge: whatever it raises, no item is lost
            groups = []
        return pd.DataFrame([(int(part["id"][i]), int(part["id"][min(g)])) for g in groups for i in g if len(g) > 1], columns=["a", "b"])

    edges = blocks(counted, group, size).groupBy(*at).applyInPandas(ask, "a long, b long")
    found = components(edges.where("a <> b"))
    return items.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def consolidate(rolled: DataFrame, judge: Judge, categories: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """rolled (KEY, value, ...) with cluster; only items of the categories are judged.

    Items are looked at many times, so they are rolled up once and kept as a checkpoint: what they are rolled from is read once.
    """
    keyed = settled(rolled.withColumn("item_", F.xxhash64(*KEY)))
    own = keyed.where(F.col("category").isin(*categories)).select("product_id", "category", F.col("item_").alias("id"), "value")
    found = judged(own, ["product_id", "category"], judge, "category", size)
    return keyed.join(found.withColumnRenamed("id", "item_"), "item_", "left").withColumn("cluster", F.coalesce("cluster", "item_")).drop("item_")
