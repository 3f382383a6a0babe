"""A keyed table of bucketed files with a manifest: updates rewrite only the buckets that they touch.

A version is a manifest, a small JSON file that names each bucket's folder. An update reads and rewrites the folders of
the buckets that hold changed keys, then puts a manifest with the next number in place at once; other buckets keep their
folders. Readers keep the version they began with. What a crash leaves before the manifest is in place is never read, and
the update can simply be run again; sources that number their batches are applied once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer put the next version in place first."""


class BucketTable:
    """Rows unique by key, in buckets by its hash. buckets bounds the manifest, and a bucket should be some 100 MB."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, fs = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """{version, folders: {bucket: folder}, applied: {source: batch}} of a version, the newest without one."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "folders": {}, "applied": {}}
        place, fs = self._fs(f"{self.path}/manifest/{found[-1] if version is None else version:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Puts the manifest in place by a rename, which fails where that version stands already."""
        draft, fs = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        final, _ = self._fs(f"{self.path}/manifest/{manifest['version']:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} exists")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        folders = self.manifest(version)["folders"]
        paths = [p for b, p in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys of a table (a column named like the key); reads their buckets alone."""
        own = keys.select(self.key).distinct()
        return self.read(only=self._touched(own)).join(own, self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most buckets rows

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, source: str | None = None, batch: int | None = None) -> dict:
        """Applies changes, unique by key, to the buckets that hold their keys; returns the counts of buckets.

        combine(old, changes) gives the new rows of those buckets; without it, a changed row replaces the old one. With
        source and batch, a batch that was applied before is left out.
        """
        now = self.manifest()
        if source is not None and now["applied"].get(source, -1) >= batch:
            return {"version": now["version"], "rewritten": 0, "kept": len(now["folders"])}
        touched = self._touched(changes)
        old = self.read(now["version"] or None, only=touched)
        columns = self.schema.fieldNames()
        new = combine(old, changes) if combine else old.join(changes.select(self.key), self.key, "left_anti").unionByName(changes.select(*columns))
        folder = f"data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        placed = new.select(*columns, self.bucket().alias("bucket_"))
        placed.repartition("bucket_").sortWithinPartitions("bucket_", self.key).write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        folders = {b: p for b, p in now["folders"].items() if int(b) not in touched}
        for b in touched:
            place, fs = self._fs(f"{self.path}/{folder}/bucket_={b}")
            if fs.exists(place):  # else all its rows are gone
                folders[str(b)] = f"{folder}/bucket_={b}"
        applied = now["applied"] | ({source: batch} if source is not None else {})
        self._commit({"version": now["version"] + 1, "folders": folders, "applied": applied})
        return {"version": now["version"] + 1, "rewritten": len(touched), "kept": len(folders) - len(set(map(str, touched)) & set(folders))}

    def delete(self, keys: DataFrame) -> dict:
        """Removes the rows of keys; only their buckets are rewritten."""
        return self.merge(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last keep, and folders that none of those names; run it while nothing is written."""
        found = self.versions()
        named = {p.split("/bucket_=")[0] for v in found[-keep:] for p in self.manifest(v)["folders"].values()}
        for v in found[:-keep]:
            place, fs = self._fs(f"{self.path}/manifest/{v:012d}.json")
            fs.delete(place, False)
        place, fs = self._fs(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(place) if f"data/{s.getPath().getName()}" not in named] if fs.exists(place) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
