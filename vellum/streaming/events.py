"""Structured Streaming over an event source, and the same as batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than the watermark are dropped by a stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), by, "n", "cents")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def breaker(events: DataFrame, key: str, failed: str, limit: int = 5) -> DataFrame:
    """(key, failures, open): a keyed counter of failures that never resets and opens a breaker at limit."""

    def fold(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        total += int(sum(p[failed].sum() for p in parts))
        state.update((total,))
        yield pd.DataFrame({key: [key_[0]], "failures": [total], "open": [total >= limit]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, failures long, open boolean", "failures long", "update", GroupStateTimeout.NoTimeout)


def breaker_batch(events: DataFrame, key: str, failed: str, limit: int = 5) -> DataFrame:
    """What the stream's last updates hold, as one aggregate."""
    total = F.sum(F.col(failed).cast("long"))
    return events.groupBy(key).agg(total.alias("failures"), (total >= limit).alias("open"))


def ingest(events: DataFrame, admit, path: str, checkpoint: str):
    """Runs admit on each micro-batch as it arrives and appends what it lets through; exactly once by batch id."""

    def write(batch: DataFrame, number: int) -> None:
        admit(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
