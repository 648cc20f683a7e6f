"""Versioned Parquet snapshots on any file system that Spark reaches.

A table is a folder with numbered manifests; a manifest lists the data files of each shard. A write
adds files, then one new manifest, made only if nobody else made that number: by a hard link on a local
file system, by a conditional put in an object store, by a rename elsewhere (it fails on HDFS if the
target is there). Files are never changed, so running queries and read views keep what they see;
`vacuum` takes away files that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflictError

SHARD = "__shard"
_OBJECT_STORES = frozenset("s3 s3a s3n gs abfs abfss wasb wasbs oss cosn".split())


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    files: dict[int, tuple[str, ...]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    def of(self, shards=None) -> list[str]:
        return [f for s, fs in sorted(self.files.items()) if shards is None or s in shards for f in fs]


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _dir(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _manifest(self, table: str, version: int) -> str:
        return f"{self._dir(table)}/manifest-{version:010d}.json"

    def version(self, table: str) -> int:
        found = self._fs.globStatus(self._path(f"{self._dir(table)}/manifest-*.json"))
        return max((int(f.getPath().getName()[9:19]) for f in found or ()), default=0)

    def snapshot(self, table: str, version: int | None = None) -> Snapshot:
        version = self.version(table) if version is None else version
        if not version:
            return Snapshot()
        stream = self._fs.open(self._path(self._manifest(table, version)))
        try:
            raw = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        known = json.loads(raw)
        return Snapshot(version, {int(k): tuple(v) for k, v in known["files"].items()}, known["rows"])

    def read(self, schema: T.StructType, snapshot: Snapshot, shards=None) -> DataFrame:
        """Rows of the snapshot; columns added since a file was written are NULL in it."""
        files = snapshot.of(shards)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def write_files(self, table: str, rows: DataFrame, order: list[str]) -> dict[int, list[str]]:
        """Write rows (with SHARD) as new files, sorted within each by `order` so that statistics prune; names by shard."""
        path = f"{self._dir(table)}/data-{uuid.uuid4().hex}"
        rows.sortWithinPartitions(SHARD, *order).write.partitionBy(SHARD).parquet(path)
        out: dict[int, list[str]] = {}
        for folder in self._fs.globStatus(self._path(f"{path}/{SHARD}=*")) or ():
            shard = int(folder.getPath().getName().split("=")[1])
            out[shard] = sorted(f.getPath().toString() for f in self._fs.globStatus(self._path(f"{folder.getPath().toString()}/*.parquet")))
        return out

    def commit(self, table: str, base: Snapshot, files: dict[int, tuple[str, ...]], rows: dict[str, int] | None = None) -> Snapshot:
        """The next version after `base`; fails if another writer was first."""
        new = Snapshot(base.version + 1, {k: tuple(v) for k, v in files.items() if v}, rows or {})
        text = json.dumps({"files": {str(k): list(v) for k, v in new.files.items()}, "rows": new.rows})
        self._fs.mkdirs(self._path(self._dir(table)))
        if not self._create(table, self._path(self._manifest(table, new.version)), bytearray(text.encode())):
            raise CommitConflictError(f"version {new.version} of {table} was written by someone else")
        return new

    def _create(self, table: str, target, data: bytearray) -> bool:
        """Make a whole file in one step; False if there is one."""
        from py4j.protocol import Py4JJavaError

        jvm, scheme = self.spark._jvm, self._fs.getUri().getScheme()
        if self._fs.exists(target):
            return False
        if scheme in _OBJECT_STORES:
            try:
                out = self._fs.createFile(target).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
                out.write(data)
                out.close()
            except Py4JJavaError:
                if self._fs.exists(target):
                    return False
                raise
            return True
        whole = self._path(f"{self._dir(table)}/.{uuid.uuid4().hex}")
        out = self._fs.create(whole, False)
        out.write(data)
        out.close()
        try:
            if scheme != "file":
                return self._fs.rename(whole, target)
            file = lambda p: jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(file(target), file(whole))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self._fs.delete(whole, False)

    def vacuum(self, table: str, keep: set[int]) -> int:
        """Remove manifests below the newest that aren't kept, and data files that no remaining version names."""
        newest = self.version(table)
        keep = keep | {newest}
        for v in range(1, newest):
            if v not in keep:
                self._fs.delete(self._path(self._manifest(table, v)), False)
        used = {f for v in keep if v for f in self.snapshot(table, v).of()}
        gone = 0
        for f in self._fs.globStatus(self._path(f"{self._dir(table)}/data-*/*/*.parquet")) or ():
            if f.getPath().toString() not in used:
                self._fs.delete(f.getPath(), False)
                gone += 1
        return gone


def tag_shard(df: DataFrame) -> DataFrame:
    """Rows read from data files with their shard, which stands in the path."""
    return df.select("*", F.regexp_extract(F.input_file_name(), rf"{SHARD}=(\d+)/", 1).cast("int").alias(SHARD))


def shard_of(bucket, shards: int, buckets: int):
    """Shards take contiguous ranges of buckets. Works on numbers and Columns."""
    if isinstance(bucket, int):
        return min((bucket - 1) * shards // buckets, shards - 1) + 1
    return F.least(F.floor((bucket - 1) * shards / buckets), F.lit(shards - 1)).cast("int") + 1
