"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), v < u, are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(edges: DataFrame, tables: common.Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable. Reads the table name of tables.

    Each round hangs larger neighbours on a node's smallest one, then a node's smaller neighbours on the smallest,
    until only stars are left; the rounds grow with the logarithm of the longest path. Minima are pre-aggregated before
    they are shuffled, and the edges of a node with very many stay where they are (common.spread_join), so the centre
    of a star is no single task. Nodes without an edge do not appear.
    """
    now = tables.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while not stars(now):
        total = 2 * now.count()
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = common.spread_join(both, least, ["u"], total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.write(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.spread_join(large, least, ["u"], total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = tables.write(small.distinct(), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
