"""Where intermediate tables go: a folder that every executor can see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Works made inside each open ``scratch`` block.
_SCOPES: list[list[Work]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master a temporary one when unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='glyphweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Whether the shuffle files of a statement go when it ends, not when the driver's memory is next cleaned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Statements that run inside leave no shuffle files behind, so disk holds what one statement shuffles."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def dealt(spark: SparkSession, rows: int, most: int) -> Iterator[None]:
    """Statements over so many rows that are written inside scan and shuffle about ``most`` rows a task, however many rows there are.

    Tables of a few columns are small on disk: by bytes alone a task would scan, and sort, the more rows of them the more there are.
    """
    parts, conf = -(-rows // most), {"spark.sql.files.maxRecordsPerFile": most}
    if parts > spark.sparkContext.defaultParallelism:
        conf |= {"spark.sql.shuffle.partitions": max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "spark.sql.files.maxPartitionBytes": 4 << 20}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def delete(spark: SparkSession, at: str) -> None:
    """Remove a folder, where it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Work:
    """Numbered Parquet tables in a fresh sub-folder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        self.number = 0
        if _SCOPES:
            _SCOPES[-1].append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: the plan behind it is cut, survives lost executors and leaves no shuffle files."""
        at = f"{self.path}/{self.number:03d}-{name}"
        self.number += 1
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(at)
        self.made.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *frames_or_names: str) -> None:
        """Delete the tables with these names, or all of them."""
        for at in list(self.made):
            if not frames_or_names or at.rsplit("-", 1)[-1] in frames_or_names:
                delete(self.spark, at)
                self.made.remove(at)


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables of operators called inside are deleted at the end; what is needed must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for work in _SCOPES.pop():
            work.drop()
