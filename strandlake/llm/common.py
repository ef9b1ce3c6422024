"""Helpers that the corpus operators share: staged tables, Arrow batches and null-safe columns."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.membership import HOT, join_hot, probable, without
from strandlake.sources.staging import staged

__all__ = ["HOT", "SPACES", "arrow_batches", "id_bucket", "join_hot", "local_path", "probable", "stage", "table", "text_or_empty", "without"]

#: White space as the contracts of the operators define it.
SPACES = "[\\x20\\x09-\\x0D]+"


def local_path(url: str) -> str | None:
    """The file-system path of a file: URL or plain path; None for any other store."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    return None if ":/" in url else os.path.abspath(url)


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives the loss of executors."""
    return staged(df, name, compression)


def arrow_batches(spark: SparkSession, size: str = "6m") -> None:
    """Bounds the session's Arrow batches by bytes, as texts may be very long.

    Spark reads the setting when a plan runs, which may be after an operator has returned, so it stays set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo modulus; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
