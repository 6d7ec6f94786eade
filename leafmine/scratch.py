"""Intermediate tables in the folder that driver and executors share.

A table that several later steps read is written once as Parquet: lost executors can't lose it, and the plan that follows
reads its size from the files. Tables that a lazy result still reads stay until the application ends.
"""

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_OPEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's own checkpoint folder. Where both are unset, a local master gets a
    temporary one, which is fine as driver and executors are one process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _close() -> None:
    """Folders of this application, at its end. What can't be reached any more is left to whoever clears the shared folder."""
    for spark, root in _OPEN:
        with contextlib.suppress(Py4JError, PySparkException, OSError, AttributeError):
            delete(spark, root)


class Scratch:
    """Tables of one run of an operator, under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/leafmine-{name}-{uuid.uuid4().hex}"
        _OPEN.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")
