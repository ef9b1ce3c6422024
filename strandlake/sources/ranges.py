"""FASTQ from byte ranges: a Python data source whose tasks find the first record of their range themselves, so records aren't shuffled."""

from __future__ import annotations

import io
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources.reads import parse_fastq
from strandlake.sources.staging import free, staged

READS = "read_id long, file string, fmt string, label string, seq string, qlabel string, qual string"
FOUND = "file string, begin long, start long, stop long, n long"
ROWS = 10_000


def _opened(file: str, whole: bool):
    """A buffered binary stream of a local path or of any file system that Arrow knows; whole files are decompressed by suffix."""
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), "/" + unquote(file[5:]).lstrip("/")) if file.startswith("file:") else fs.FileSystem.from_uri(file)
    return io.BufferedReader(system.open_input_stream(path) if whole else system.open_input_file(path), 1 << 20)


class _Lines:
    """Lines of a stream, and where the one that was given last begins."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.after, self.last, self.kept = stream, at, at, b"", b""

    def __iter__(self):
        return self

    def __next__(self) -> str:
        self.last, self.kept = self.kept or self.stream.readline(), b""
        self.at, self.after = self.after, self.after + len(self.last)
        if not self.last:
            raise StopIteration
        return self.last.decode("utf-8", "replace")

    def keep(self, lines: list[bytes], at: int) -> None:
        """Puts lines back, of which the first begins at at."""
        self.stream, self.at, self.after = _Ahead(lines, self.stream), at, at

    def next_record(self) -> int:
        """Where the next record begins, once the line behind a record has been given: empty lines are passed over."""
        while self.last and not self.last.rstrip(b"\r\n"):
            self.kept = self.stream.readline()
            if self.kept.rstrip(b"\r\n") or not self.kept:
                return self.after
            self.after, self.kept = self.after + len(self.kept), b""
        return self.at


class _Ahead:
    def __init__(self, lines: list[bytes], stream):
        self.lines, self.stream = deque(lines), stream

    def readline(self) -> bytes:
        return self.lines.popleft() if self.lines else self.stream.readline()


def _synchronised(stream, begin: int) -> _Lines:
    """Lines from the first record that begins at begin or later.

    A title has a line with + two lines on. Of four-line records no other line with @ has, as the line two behind
    a quality is a sequence. Where records are wrapped a quality may look like it, which the check finds.
    """
    if not begin:
        stream = _Ahead([], stream)
        lines = _Lines(stream, 0)
        held, at = stream.readline(), 0
        while held and not held.rstrip(b"\r\n"):
            at, held = at + len(held), stream.readline()
        lines.keep([held] if held else [], at)
        return lines
    stream.seek(begin - 1)
    at = begin - 1 + len(stream.readline())
    lines, three = _Lines(stream, at), deque()
    while True:
        while len(three) < 3 and (line := stream.readline()):
            three.append(line)
        if len(three) < 3:  # no whole record is left
            lines.keep([], at + sum(map(len, three)))
            return lines
        if three[0].startswith(b"@") and three[2].startswith(b"+"):
            lines.keep(list(three), at)
            return lines
        at += len(three.popleft())


@dataclass
class Range(InputPartition):
    """Of file the records that begin from begin on and before end (None: all of it); first: the read_id of the first one."""

    file: str
    begin: int
    end: int | None
    first: int

    def __post_init__(self):
        super().__init__(self.file)

    def records(self) -> Iterator[tuple[tuple[str, str, str, str] | None, int]]:
        """Records with the place behind each; at first None with the place of the first one."""
        with _opened(self.file, self.end is None) as stream:
            lines = _Lines(stream, 0) if self.end is None else _synchronised(stream, self.begin)
            place = lines.after
            yield None, place
            if self.end is not None and place >= self.end:
                return
            for record in parse_fastq(lines):
                place = lines.next_record()
                yield record, place
                if self.end is not None and place >= self.end:
                    return


class FastqRanges(DataSource):
    """Options: ranges, a Parquet folder of file, begin, end, first; boundaries, whether only a row a range is asked for."""

    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return FOUND if self.options.get("boundaries") == "true" else READS

    def reader(self, schema):
        return _Reader(self.options["ranges"], self.options.get("boundaries") == "true")


class _Reader(DataSourceReader):
    def __init__(self, ranges: str, boundaries: bool):
        self.ranges, self.boundaries = ranges, boundaries

    def partitions(self):
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = (fs.LocalFileSystem(), "/" + unquote(self.ranges[5:]).lstrip("/")) if self.ranges.startswith("file:") else fs.FileSystem.from_uri(self.ranges)
        files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        return [Range(**row) for f in sorted(files) for row in pq.read_table(f, filesystem=system, partitioning=None).to_pylist()]  # a row a task

    def read(self, partition: Range):
        import pyarrow as pa

        if self.boundaries:
            start = place = None
            n = 0
            try:
                for record, place in partition.records():
                    if record is None:
                        start = place
                    else:
                        n += 1
            except ValueError:  # told by a missing stop; the file is then read in order, which raises if it is wrong
                place = None
            yield (partition.file, partition.begin, start, place, n)
            return
        names = ["read_id", "file", "fmt", "label", "seq", "qlabel", "qual"]
        kinds = [pa.int64()] + [pa.string()] * 6
        out = []
        i = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for record, _ in partition.records():
            if record is None:
                continue
            out.append((partition.first + i, partition.file, "fastq", *record))
            i += 1
            if len(out) == ROWS:
                yield batch()
                out = []
        if out:
            yield batch()


def _through(spark: SparkSession, ranges: DataFrame, boundaries: bool) -> tuple[DataFrame, DataFrame]:
    held = staged(ranges.select("file", "begin", "end", "first"), "ranges")
    spark.dataSource.register(FastqRanges)
    folder = held.inputFiles()[0].rsplit("/", 1)[0]
    return held, spark.read.format("fastq_ranges").option("ranges", folder).option("boundaries", str(boundaries).lower()).load()


def read_fastq_ranges(spark: SparkSession, *paths: str, split: int = 128 << 20, check: bool = True) -> DataFrame:
    """Records of FASTQ files as read_fastq() returns them, from ranges of split bytes, without a shuffle.

    check parses all ranges once before: where each range ends at the record with which the next one begins, all
    ranges hold true records (the first begins with the file), and their counts number the records. A file for which
    this fails, such as one with wrapped lines where a quality looks like a title, is read in order by one task, and so are
    compressed files. Without check, for files known to have four lines a record, ids only grow by range. A record that doesn't fit
    stops the job; empty files give no rows. Files are opened by Arrow, so tasks must reach them by the same path.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), "length").where("length > 0")
    files = staged(files.select("file", "length", F.expr("dense_rank() over (order by file) - 1").cast("long").alias("no"), F.col("file").rlike(r"\.(gz|bz2|zst|lz4)$").alias("packed")), "files")  # a row a file
    if files.isEmpty():
        return spark.createDataFrame([], READS)
    first = F.shiftleft(F.col("no"), 33)
    whole = lambda held: held.select("file", F.lit(0).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), first.alias("first"))
    cut = files.where("not packed").select("file", "no", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))
    cut = cut.select("file", "no", "begin", F.least("length", F.col("begin") + split).alias("end"), (first + F.col("begin")).alias("first"))
    if check and not cut.isEmpty():
        held, told = _through(spark, cut, True)
        told = staged(told, "boundaries")
        free(held)
        told = told.withColumn("fits", F.expr("stop is not null and (begin = 0 or start = lag(stop) over (partition by file order by begin))"))
        told = told.withColumn("fits", F.expr("min(coalesce(fits, false)) over (partition by file)")).withColumn("ahead", F.expr("coalesce(sum(n) over (partition by file order by begin rows between unbounded preceding and 1 preceding), 0)"))
        cut = cut.drop("first").join(told.select("file", "begin", "fits", "ahead"), ["file", "begin"]).withColumn("first", first + F.col("ahead"))
        odd = files.join(told.where("not fits").select("file").distinct(), "file", "left_semi")
        ranges = cut.where("fits").select("file", "begin", "end", "first").unionByName(whole(odd))
    else:
        ranges = cut.select("file", "begin", "end", "first")
    return _through(spark, ranges.unionByName(whole(files.where("packed"))), False)[1]
