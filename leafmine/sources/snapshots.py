"""Tables that last between runs, published as a whole (IN4, SNK1 to SNK6).

A store is a folder. A run writes the tables it has under names of its own and, as its last act, one small manifest that names a
folder for each table and bucket. Readers take the newest manifest and read what it names, so a run that broke off
shows nothing, and a reader that holds a manifest goes on reading the snapshot it names. Buckets that a run doesn't touch are
named again, not copied.
"""

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column by which tables are cut into buckets; so many of them.
KEY, BUCKETS = "tender", 64


def bucket(key: str = KEY, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """version: 0 for an empty store. tables: of each table the folder of each bucket that has rows."""

    version: int
    tables: dict


class Store:
    """A store in any file system that Spark writes to: files are reached through Hadoop's interface alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io, self._chars = jvm.org.apache.commons.io.IOUtils, jvm.java.nio.charset.StandardCharsets.UTF_8

    def _file(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(name[:-5]) for s in self._fs.listStatus(at) if (name := s.getPath().getName()).endswith(".json") and name[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or an older one."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return Snapshot(0, {})
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return Snapshot(version, json.loads(self._io.toString(stream, self._chars)))
        finally:
            stream.close()

    def read(self, table: str, snapshot: Snapshot, schema: str) -> DataFrame:
        """A table of a snapshot; without rows if it has none. schema: DDL."""
        found = sorted(snapshot.tables.get(table, {}).values())
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in found]) if found else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame], base: Snapshot, touched: list[int] | None = None, key: str = KEY) -> Snapshot:
        """Write tables as part of the snapshot after base, which nobody sees before commit().

        touched: buckets that the tables stand for; others stay as base has them. None: all, and base's rows of these tables go."""
        run = f"runs/{base.version + 1:012d}-{uuid.uuid4().hex}"
        named = dict(base.tables)
        for name, df in tables.items():
            path = f"{self.root}/{run}/{name}"
            df.withColumn("_bucket", bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
            at = self._path(path)
            new = {d.split("=")[1]: f"{run}/{name}/{d}" for s in self._fs.listStatus(at) if (d := s.getPath().getName()).startswith("_bucket=")}
            kept = {} if touched is None else {b: p for b, p in base.tables.get(name, {}).items() if int(b) not in touched}
            named[name] = {**kept, **new}
        return Snapshot(base.version + 1, named)

    def commit(self, new: Snapshot) -> Snapshot:
        """Publish what write() has written. Whoever wrote on a base that is no longer the newest fails, and nothing of it
        shows: two runs at once can't lose each other's rows. The manifest is made elsewhere and moved to its name."""
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json"), self._path(self._file(new.version))
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft)
        try:
            self._io.write(json.dumps(new.tables), stream, self._chars)
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another run has published version {new.version}")
        return new

    def clean(self, keep: int = 2) -> None:
        """Delete manifests but the newest `keep`, and folders of runs that none of these names. Not while a run is writing."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep] if keep else known
        used = {p.split("/")[1] for v in kept for t in self.snapshot(v).tables.values() for p in t.values()}
        for v in gone:
            self._fs.delete(self._path(self._file(v)), False)
        runs = self._path(f"{self.root}/runs")
        for s in self._fs.listStatus(runs) if self._fs.exists(runs) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
