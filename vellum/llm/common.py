"""What the operators of this subpackage share: reading, stage tables, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch handed to Python code is cut into slices of about this many text bytes.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-vellum-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder. Lineage ends at each, so lost executors cost one step.

    On leaving the block, those not named in keep are deleted: what the job returns may read only kept tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for name in list(self.paths):
            self.drop(name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; an older table of the name goes once the new one stands."""
        path = f"{shared_dir(self.spark)}/vellum-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        for name in names:
            self.paths.pop(name, None)

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder that stays, read back: what a job returns may read it."""
    with Scratch(df.sparkSession) as tables:
        out = tables.write(df, name)
        tables.keep(name)
    return out


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 * SLICE_BYTES) -> Iterator[None]:
    """What runs in this block hands texts to Python in Arrow batches of about so many bytes, which JVM and worker both hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Keys with more rows than this, and than total / HOT_KEYS, are hot: at most HOT_KEYS of them exist.
HOT_ROWS, HOT_KEYS = 1024, 200_000


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], total: int) -> DataFrame:
    """Left join of rows to a lookup that is unique by on and has n, its number of rows of that key (dropped).

    total: the number of all rows. Hot keys, of which there are at most HOT_KEYS, are broadcast, so their rows stay
    where they are; the others meet by a shuffle. Rows with a null key find nothing and stay where they are too.
    """
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    values = [c for c in lookup.columns if c not in on and c != "n"]
    few = lookup.where(hot).select(*on, F.struct(*values).alias("found"))
    near = rows.join(F.broadcast(few), on, "left")  # at most HOT_KEYS rows
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    stays = near.where(F.col("found").isNotNull() | null).select(*rows.columns, *[F.col(f"found.{c}").alias(c) for c in values])
    moves = near.where(F.col("found").isNull() & ~null).drop("found").join(lookup.where(~hot).drop("n"), on, "left")
    return stays.unionByName(moves.select(*rows.columns, *values))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that each part has about max_bytes in a string column; a longer single value stays whole."""
    n, start, total = batch.num_rows, 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if total and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < n:
        yield batch.slice(start)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str, text: int | None = None) -> DataFrame:
    """mapInArrow where function gets one slice at a time and returns one batch, a list of them, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text) if text is not None else [batch]:
                if part.num_rows and (out := function(part)) is not None:
                    yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)
