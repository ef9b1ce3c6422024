"""Tables written to the shared folder, where an iterative operator's lineage ends."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-strandlake-")
    return _own[app]


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    system, there = _file_system(spark, path)
    system.deleteOnExit(there)
    return path


def mapped_path(spark: SparkSession, name: str) -> str | None:
    """A fresh path below the shared folder as tasks can open and map it; None where that folder is in another store."""
    path = new_path(spark, name)
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if ":/" in path else os.path.abspath(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind: what they return is in a table or at the driver."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends there and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.staged_at = path
    return held


def free(*tables: DataFrame | None) -> None:
    """Deletes staged tables whose successors are written, so that nothing reads them any more; other DataFrames are passed over."""
    for df in tables:
        path = getattr(df, "staged_at", None) if df is not None else None
        if isinstance(path, str):
            system, there = _file_system(df.sparkSession, path)
            system.delete(there, True)
