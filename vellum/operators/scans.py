"""Running values of a key's rows in order, for keys of any size.

A key of up to MOST rows is one window. Where a larger one exists, rows are cut into ranges of (key, order), each range is
scanned on its own, and one summary for each key and range is composed over the ranges before it and joined back, so a
key with half of all rows spreads over as many tasks as its ranges. Both give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.sources.sinks import settled

MOST = 2_000_000


def largest(rows: DataFrame, key: str) -> int:
    """Rows of the largest key; counted where the rows lie."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with range_, the number of their range of (key, order); kept as a checkpoint, for ranges are sampled anew each time."""
    return settled(rows.repartitionByRange(key, *order).withColumn("range_", F.spark_partition_id()))


def _upto(*by: str, order: list):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def _carried(rows: DataFrame, key: str, summary: list[Column], carry: dict[str, Column]) -> DataFrame:
    """rows with what their key's earlier ranges hand on: carry is computed over one row for each key and range."""
    per = rows.groupBy(key, "range_").agg(*summary)
    for name, value in carry.items():
        per = per.withColumn(name, value)
    lines = per.select(F.col(key).alias("key_"), F.col("range_").alias("from_"), *carry)
    return rows.join(lines, rows[key].eqNullSafe(F.col("key_")) & (F.col("range_") == F.col("from_"))).drop("key_", "from_")


def running_max(rows: DataFrame, key: str, value: str, order: list[str], alias: str) -> DataFrame:
    """The largest value so far of each row's key; nulls are passed over."""
    if largest(rows, key) <= MOST:
        return rows.withColumn(alias, F.max(value).over(_upto(key, order=order)))
    cut = ranged(rows, key, order)
    before = F.max("top_").over(W.partitionBy(key).orderBy("range_").rowsBetween(W.unboundedPreceding, -1))
    both = _carried(cut, key, [F.max(value).alias("top_")], {"before_": before})
    return both.withColumn(alias, F.greatest(F.max(value).over(_upto(key, "range_", order=order)), "before_")).drop("range_", "before_")


def previous(rows: DataFrame, key: str, value: str, order: list[str], alias: str) -> DataFrame:
    """The value of the row before, null for a key's first row."""
    if largest(rows, key) <= MOST:
        return rows.withColumn(alias, F.lag(value).over(W.partitionBy(key).orderBy(*order)))
    cut = ranged(rows, key, order)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last_")
    both = _carried(cut, key, [last], {"before_": F.lag("last_").over(W.partitionBy(key).orderBy("range_"))})
    own = W.partitionBy(key, "range_").orderBy(*order)
    first = F.row_number().over(own) == 1
    return both.withColumn(alias, F.when(first, F.col("before_.v")).otherwise(F.lag(value).over(own))).drop("range_", "before_")


def streaks(rows: DataFrame, key: str, success: Column, order: list[str], alias: str = "streak", seen: str | None = None) -> DataFrame:
    """Rows in a row without a success up to each one, reset by a success; seen: whether the key had a success by then.

    A range's summary is whether it has a success and its rows after the last one; those compose by adding up while
    there is none.
    """
    marked = rows.withColumn("hit_", F.coalesce(success, F.lit(False)).cast("int"))
    small = largest(rows, key) <= MOST
    cut = marked.withColumn("range_", F.lit(0)) if small else ranged(marked, key, order)
    own = _upto(key, "range_", order=order)
    cut = cut.withColumn("hits_", F.sum("hit_").over(own))
    cut = cut.withColumn("since_", F.sum(1 - F.col("hit_")).over(_upto(key, "range_", "hits_", order=order)))
    if small:
        out = cut.withColumn(alias, F.col("since_"))
        return (out.withColumn(seen, F.col("hits_") > 0) if seen else out).drop("range_", "hit_", "hits_", "since_")
    tail = F.max_by("since_", F.struct(*order)).alias("tail_")
    line = W.partitionBy(key).orderBy("range_")
    carry = {
        "group_": F.sum("any_").over(line.rowsBetween(W.unboundedPreceding, 0)),
        "run_": F.sum("tail_").over(W.partitionBy(key, "group_").orderBy("range_").rowsBetween(W.unboundedPreceding, 0)),
        "before_": F.coalesce(F.lag("run_").over(line), F.lit(0)),
        "seen_": F.coalesce(F.lag("group_").over(line), F.lit(0)) > 0,
    }
    both = _carried(cut, key, [F.max("hit_").alias("any_"), tail], carry)
    out = both.withColumn(alias, F.col("since_") + F.when(F.col("hits_") == 0, F.col("before_")).otherwise(0))
    out = out.withColumn(seen, (F.col("hits_") > 0) | F.col("seen_")) if seen else out
    return out.drop("range_", "hit_", "hits_", "since_", *carry)
