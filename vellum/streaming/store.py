"""Streams that end in tables: pages admitted and stored as they arrive, and keyed folds kept as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators.ingest import SHORTEST
from vellum.sources.buckets import BucketTable
from vellum.sources.sinks import workspace

from . import lifecycle

#: Partitions of a fold's state for each core. A batch loads and commits every partition, which takes some 0.3 s of a task
#: whatever it holds; a task holds a bucket at a time, so its memory does not depend on this. A stream keeps its first number.
ROUNDS = 3
STORED = "key string, owner string, doc_id long, n_docs long"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream, be it one file or a folder of files.

    A batch takes so many files, or, if bytes_per_trigger is given, files until they have so many bytes.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    reader = spark.readStream.schema(schema).option(*limit)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def admitted(pages: DataFrame, owner: str = "source", doc: str = "doc_id", content: str = "text") -> DataFrame:
    """(doc_id, owner, key): pages that are long enough and not garbled, keyed by owner and content fingerprint."""
    kept = pages.where((F.length(F.coalesce(content, F.lit(""))) >= SHORTEST) & ~text.garbled(F.col(content)))
    who = F.coalesce(F.col(owner), F.lit(""))
    return kept.select(F.col(doc).cast("long").alias("doc_id"), who.alias("owner"), F.md5(F.concat(who, F.lit("\n"), text.fingerprint(F.col(content)))).alias("key"))


class PageStore:
    """Pages by owner and content: a first page is inserted, others of its content are linked to the smallest document.

    Each micro-batch looks up its fingerprints in their buckets, logs what it does to each page, and merges; a batch whose
    merge is in place is left out when it comes again, so a restart at any point changes nothing. Work grows with the
    batch and the buckets it touches. The log holds each page's key; a row holds only the smallest document and a count,
    however many pages share a content.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = BucketTable(spark, f"{path}/pages", "key", spark.createDataFrame([], STORED).schema, buckets)
        self.log, self.checkpoint, self.spark = f"{path}/log", f"{path}/checkpoint", spark

    def write(self, batch: DataFrame, number: int) -> None:
        if self.table.manifest()["applied"].get("pages", -1) >= number:
            return
        pages = batch.sparkSession.createDataFrame([], "doc_id long, owner string, key string").unionByName(admitted(batch)).persist()
        try:
            self.store(pages, number)
        finally:
            pages.unpersist()

    def store(self, pages: DataFrame, number: int) -> None:
        """Takes in a batch's admitted pages, which are looked at several times: texts are read and judged once."""
        own = pages.groupBy("key").agg(F.first("owner").alias("owner"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))
        known = self.table.lookup(own).select("key", F.lit(True).alias("known"))
        first = own.select("key", F.col("doc_id").alias("first")).join(known, "key", "left")
        action = F.when(F.col("known").isNull() & F.col("doc_id").eqNullSafe(F.col("first")), "insert").otherwise("link")
        pages.join(first, "key").select("doc_id", "key", action.alias("action")).write.mode("overwrite").parquet(f"{self.log}/batch={number:012d}")
        self.table.merge(own, self.both, "pages", number)

    @staticmethod
    def both(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new.select(*old.columns)).groupBy("key").agg(F.first("owner").alias("owner"), F.min("doc_id").alias("doc_id"), F.sum("n_docs").alias("n_docs"))

    def run(self, pages: DataFrame) -> None:
        """Takes in what a stream has to give, from where an earlier run ended."""
        pages.writeStream.foreachBatch(self.write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()


class FoldedEvents:
    """A fold over a stream of (key, ts, tie, value), kept as files; run() may be called again when more has come."""

    def __init__(self, spark: SparkSession, path: str, fold: lifecycle.Fold, late: str = "1 hour"):
        self.spark, self.path, self.fold, self.late = spark, path, fold, late
        self.clock = f"{path}/clock"
        self.schema = "key long, ts timestamp, tie long, value string"
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self.clock)

    def run(self, events: DataFrame, settle: bool = True) -> None:
        """settle: also raises what is due by the last watermark; a later run does so otherwise."""
        spark = self.spark
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), ROUNDS * spark.sparkContext.defaultParallelism)
        settings = lifecycle.STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(settle).lower(), "spark.sql.shuffle.partitions": str(tasks)}
        before = {name: spark.conf.get(name, None) for name in settings}
        for name, value in settings.items():
            spark.conf.set(name, value)
        clock = spark.readStream.schema(self.schema).parquet(self.clock)
        both = events.select("key", "ts", "tie", "value").unionByName(clock)
        keep = lambda batch, number: batch.where("key <> -1").write.mode("overwrite").parquet(f"{self.path}/out/batch={number:012d}")
        try:
            lifecycle.folded(both, self.fold, self.late).writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            for name, value in before.items():
                spark.conf.set(name, value) if value else spark.conf.unset(name)

    def advance(self, to) -> None:
        """Tells the stream that time has come so far, by an event of the key -1; the next run raises what fell due."""
        self.spark.createDataFrame([(-1, to, 0, "pending")], self.schema).write.mode("append").parquet(self.clock)

    def result(self) -> DataFrame:
        return self.spark.read.schema(lifecycle.OUT).parquet(f"{self.path}/out/*")


def page_store(spark: SparkSession) -> PageStore:
    return PageStore(spark, workspace(spark, "pages"))
