"""Writes of tables, with a dry run that only counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = (), dry_run: bool = False, **options: str) -> int | None:
    """Writes df (parquet, csv, json, orc) and returns None; a dry run writes nothing and returns the rows it would have written."""
    if dry_run:
        return df.count()
    writer = df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options)
    (writer.partitionBy(*by) if by else writer).save(path)
    return None


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table; df must not read the path that it overwrites."""
    df.write.format(kind).mode("overwrite").save(path)


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir; only a local session may do without that setting."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-vellum-"))
    return df.checkpoint()


def workspace(spark, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; only a local session may do without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-vellum-")
    return f"{found.rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"
