"""Signals in log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memory_signals(lines: DataFrame, key: str, seq: str, line: str, pattern: str, oom: str = r"(?i)out of memory|oom|killed") -> DataFrame:
    """(key, samples, most, latest, oom): figures that a pattern captures in log lines."""
    figure = F.regexp_extract(line, pattern, 1).try_cast("double")
    rows = lines.select(key, seq, F.col(line).rlike(oom).alias("hit"), figure.alias("v"))
    return rows.groupBy(key).agg(F.count("v").alias("samples"), F.max("v").alias("most"), F.max_by("v", F.when(F.col("v").isNotNull(), F.col(seq))).alias("latest"), F.bool_or("hit").alias("oom"))
