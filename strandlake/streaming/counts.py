"""Incremental k-mer counting and classification over Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.seq import canonical, kmers
from strandlake.operators.classify import read_masks


class CountTable:
    """Counts of k-mers by batch, kept in a folder beside the stream's checkpoint, so that a restart goes on where it ended.

    Each batch writes its own counts under its number; every so many batches these and the counts so far
    become one table, and what it holds is deleted. A batch that is delivered again replaces what it
    wrote, or is passed over if a table holds it already. Only folders whose write has ended are read.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, seq: str = "seq", every: int = 8):
        self.spark, self.folder, self.k, self.seq, self.every = spark, folder.rstrip("/"), k, seq, every

    def _held(self) -> tuple[int, list[int]]:
        """(the last batch of the latest whole table, -1 without one; the batches written since)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return -1, []
        names = [(x.getPath(), *x.getPath().getName().split("-")) for x in system.listStatus(path)]
        done = [(kind, int(n)) for at, kind, n in names if system.exists(at.suffix("/_SUCCESS"))]
        whole = max((n for kind, n in done if kind == "whole"), default=-1)
        return whole, sorted(n for kind, n in done if kind == "batch" and n > whole)

    def _drop(self, kind: str, number: int) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @property
    def table(self) -> DataFrame:
        """kmer, n over all batches so far."""
        whole, batches = self._held()
        out = self.spark.createDataFrame([], "kmer string, n long")
        for name in ([f"whole-{whole}"] if whole >= 0 else []) + [f"batch-{n}" for n in batches]:
            out = out.unionByName(self.spark.read.schema("kmer string, n long").parquet(f"{self.folder}/{name}"))
        return out.groupBy("kmer").agg(F.sum("n").alias("n"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        whole, batches = self._held()
        if number <= whole:
            return
        fresh = kmers(batch, self.k, self.seq).select(canonical("kmer").alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
        fresh.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        since = sorted({*batches, number})
        if len(since) >= self.every:
            self.table.write.mode("overwrite").parquet(f"{self.folder}/whole-{number}")
            for n in since:
                self._drop("batch", n)
            if whole >= 0:
                self._drop("whole", whole)


def count_stream(stream: DataFrame, k: int, checkpoint: str, seq: str = "seq", every: int = 8) -> CountTable:
    """Counts what a stream has to offer now, on top of what was counted with this checkpoint before, and returns the table."""
    out = CountTable(stream.sparkSession, f"{checkpoint.rstrip('/')}-counts", k, seq, every)
    query = stream.writeStream.foreachBatch(out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def classify_batches(stream: DataFrame, index: DataFrame, k: int, sink, checkpoint: str, key: str = "read_id"):
    """Each micro-batch's read masks go to sink(DataFrame, batch number)."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(read_masks(batch, index, k, key), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window start, key, n by event time, for batch and streaming tables alike; rows later than ``late`` are dropped in a stream."""
    held = events.withWatermark(ts, late) if events.isStreaming else events
    return held.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
