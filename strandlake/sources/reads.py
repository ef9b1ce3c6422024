"""Read sources (FASTA, FASTQ, lines), sinks and the stores of sets and graphs.

A reads table has read_id, file, fmt, label, seq, qlabel, qual. Compressed files are read by suffix.
FASTA splits at record starts. FASTQ lines are numbered by file, so records of four lines meet in parallel;
files that wrap lines are parsed in order, each as a stream of lines through one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.staging import staged

FASTQ = "label string, seq string, qlabel string, qual string"


def _numbered(df: DataFrame, fmt: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("read_id"), "file", F.lit(fmt).alias("fmt"), "label", "seq", "qlabel", "qual")


def read_fasta(spark: SparkSession, *paths: str, check: bool = True) -> DataFrame:
    """Records of a label line and any number of sequence lines. Text before a file's first record is a ValueError.

    The check is a pass over the text before the table is returned; check=False leaves it out.
    """
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.input_file_name().alias("file"), F.col("value"))
    if check:  # only what stands before the first separator of a file can begin with >
        first = raw.where(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "").groupBy("file").agg(F.max(F.col("value").rlike(r"^\s*>")).alias("ok"))
        wrong = [r.file for r in first.where("not ok").limit(3).collect()]
        if wrong:
            raise ValueError(f"text before the first record: {wrong}")
    raw = raw.where(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "")
    whole = F.regexp_replace("value", r"^\s*>", "")
    parts = F.split(F.regexp_replace(whole, "\r", ""), "\n", 2)
    held = raw.select("file", F.get(parts, F.lit(0)).alias("label"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))
    return _numbered(held.withColumn("qlabel", F.lit(None).cast("string")).withColumn("qual", F.lit(None).cast("string")), "fasta")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Each line a read of quality B; empty lines stay, as mates are matched by number."""
    held = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.lit(None).cast("string").alias("label"), F.col("value").alias("seq"), F.lit(None).cast("string").alias("qlabel"), F.expr("repeat('B', length(value))").alias("qual"))
    return _numbered(held, "line")


def parse_fastq(lines: Iterable[str]) -> Iterator[tuple[str, str, str, str]]:
    """(label, seq, qlabel, qual) records; ValueError where titles or lengths don't fit."""
    it = iter(lines)
    line = next(it, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if not line:
            line = next(it, None)
            continue
        if not line.startswith("@"):
            raise ValueError(f"a record must start with @: {line[:40]!r}")
        label, seq, qual = line[1:], [], []
        line = next(it, None)
        while line is not None and not line.startswith("+"):
            seq.append(line.rstrip("\r\n"))
            line = next(it, None)
        if line is None:
            raise ValueError(f"record {label!r} has no quality")
        qlabel, bases, got = line.rstrip("\r\n")[1:], "".join(seq), 0
        if qlabel and qlabel != label:
            raise ValueError(f"labels differ: {label!r}, {qlabel!r}")
        line = next(it, None)
        while line is not None and (got < len(bases) or not qual and not bases):
            qual.append(line.rstrip("\r\n"))
            got += len(qual[-1])
            line = next(it, None)
            if not bases:
                break
        if got != len(bases):
            raise ValueError(f"record {label!r}: {len(bases)} bases, {got} qualities")
        yield label, bases, qlabel, "".join(qual)


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, file_no, line (from 0 in its file), value. Each split counts its lines; what lies ahead of a split is a sum over one row a split."""
    raw = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.col("value"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = splits.select("file", "block", "first", F.expr("coalesce(sum(n) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0)").alias("ahead"), F.expr("dense_rank() over (order by file) - 1").cast("long").alias("file_no"))
    return raw.join(F.broadcast(ahead), ["file", "block"]).select("file", "file_no", (F.col("ahead") + F.col("at") - F.col("first")).alias("line"), "value")  # one row a split


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of FASTQ files, in files with wrapped lines too; a record that doesn't fit stops the job.

    Files whose records all have four lines are put together by line number, over all tasks. The others
    are sorted by line and parsed in order, a line at a time. The records are written once.
    """
    lines = numbered_lines(spark, *paths).withColumn("value", F.regexp_replace("value", "\r$", ""))
    place = [F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(c) for i, c in enumerate(("label", "seq", "qlabel", "qual"))]
    four = lines.groupBy("file", "file_no", F.expr("line div 4").alias("record")).agg(*place, F.max(F.length("value")).alias("longest")).where("longest > 0")
    name = F.expr("substring(label, 2)")
    plain = F.col("label").startswith("@") & F.col("qlabel").startswith("+") & (F.length("seq") == F.length("qual")) & ((F.length("qlabel") == 1) | (F.expr("substring(qlabel, 2)") == name))
    four = staged(four.select("file", "file_no", "record", name.alias("label"), "seq", F.expr("substring(qlabel, 2)").alias("qlabel"), "qual", F.coalesce(plain, F.lit(False)).alias("plain")), "fastq")
    wrapped = staged(four.where("not plain").select("file").distinct(), "wrapped")
    columns = ["file", "file_no", "record", "label", "seq", "qlabel", "qual"]
    held = four.select(columns)
    if not wrapped.isEmpty():

        def run(batches):
            import pandas as pd

            rows = ((f, n, v) for pdf in batches for f, n, v in zip(pdf["file"], pdf["file_no"], pdf["value"], strict=True))
            out = []
            for (file, number), some in groupby(rows, key=lambda r: r[:2]):
                for i, record in enumerate(parse_fastq(v for _, _, v in some)):
                    out.append((file, number, i, *record))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

        ordered = lines.join(wrapped, "file", "left_semi").repartition("file").sortWithinPartitions("file", "line")
        parsed = staged(ordered.mapInPandas(run, f"file string, file_no long, record long, {FASTQ}"), "fastq")
        held = held.join(wrapped, "file", "left_anti").unionByName(parsed)
    return held.select((F.shiftleft("file_no", 33) + F.col("record")).alias("read_id"), "file", F.lit("fastq").alias("fmt"), "label", "seq", "qlabel", "qual")


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The names in a file of names."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def union(*reads: DataFrame) -> DataFrame:
    out = reads[0]
    for r in reads[1:]:
        out = out.unionByName(r)
    return out.withColumn("read_id", F.monotonically_increasing_id())


def numbered(reads: DataFrame) -> DataFrame:
    """Adds ordinal: the read's place in its file. Numbers come per partition, so a file isn't sorted in one task."""
    held = reads.withColumn("__part", F.shiftright("read_id", 33)).withColumn("__at", F.expr("read_id & ((1L << 33) - 1)"))
    first = held.groupBy("file", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    first = first.select("file", "__part", "__first", F.expr("coalesce(sum(__n) over (partition by file order by __part rows between unbounded preceding and 1 preceding), 0)").alias("__ahead"))
    return held.join(F.broadcast(first), ["file", "__part"]).select(*reads.columns, (F.col("__ahead") + F.col("__at") - F.col("__first")).alias("ordinal"))


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, r1, r2: the n-th reads of both files, as far as the shorter goes."""
    a = numbered(left).select(F.col("ordinal").alias("pair_id"), F.struct(*left.columns).alias("r1"))
    b = numbered(right).select(F.col("ordinal").alias("pair_id"), F.struct(*right.columns).alias("r2"))
    return a.join(b, "pair_id")


# ---- sinks and stores


def fasta_text(df: DataFrame, label: str, seq: str = "seq", width: int = 60) -> DataFrame:
    """value: records as text, wrapped at width (0: not)."""
    body = F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else F.col(seq)
    return df.select(F.concat(F.lit(">"), F.col(label).cast("string"), F.lit("\n"), body).alias("value"))


def same_format_text(reads: DataFrame, *keep: str) -> DataFrame:
    """The columns kept and value: each read as its source had it."""
    fastq = F.concat(F.lit("@"), F.col("label"), F.lit("\n"), F.col("seq"), F.lit("\n+"), F.coalesce("qlabel", F.lit("")), F.lit("\n"), F.col("qual"))
    fasta = F.concat(F.lit(">"), F.col("label"), F.lit("\n"), F.col("seq"))
    return reads.select(*keep, F.when(F.col("fmt") == "fastq", fastq).when(F.col("fmt") == "fasta", fasta).otherwise(F.col("seq")).alias("value"))


def save_by_class(reads: DataFrame, classes: DataFrame, path: str, key: str = "read_id", mate: str | None = None) -> None:
    """Writes every read, in its source's format, below path/cls=<class>, and below mate=<mate> if that column is named; reads without a class go to 'none'.

    Mates share a key and so a class. Reads are dealt and sorted by class and key, so the n-th files of both mates of a class
    hold the same keys in the same order. classes: key, cls, a row a key.
    """
    told = reads.join(classes.select(key, "cls"), key, "left").withColumn("cls", F.coalesce("cls", F.lit("none")))
    dealt = told.repartitionByRange("cls", key).sortWithinPartitions("cls", *([mate] if mate else []), key)
    by = ["cls", *([mate] if mate else [])]
    same_format_text(dealt, *by).write.mode("overwrite").partitionBy(*by).text(path)


def save(df: DataFrame, path: str, kind: str, k: int, asymmetric: bool = False) -> None:
    """A set or graph as Parquet beside a one-row table of its kind, k and version."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(kind, k, 1, asymmetric)], "kind string, k int, version int, asymmetric boolean").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, int]:
    about = spark.read.json(f"{path}/about").first()
    if about.kind != kind or about.version != 1:
        raise ValueError(f"{path} holds {about.kind} of version {about.version}, not {kind} of version 1")
    return spark.read.parquet(f"{path}/data"), int(about.k)


#: Version in the headers of text dumps.
DUMP_VERSION = 1


def graph_text(edges: DataFrame, k: int | None = None, asymmetric: bool = False) -> DataFrame:
    """value: edge and count, tab-separated, in order of edges; with k, two header lines before: the version, then k, number of edges and flags."""
    body = edges.select("edge", F.concat_ws("\t", "edge", F.col("count").cast("string")).alias("value"))
    if k is not None:
        head = edges.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit("").alias("edge"), F.lit(f"#{DUMP_VERSION}").alias("value")), F.struct(F.lit(" ").alias("edge"), F.concat(F.lit(f"{k} "), F.col("n").cast("string"), F.lit(f" {int(asymmetric)}")).alias("value")))).alias("h")).select("h.*")
        body = head.unionByName(body)
    return body.orderBy("edge").select("value")


def parse_graph_text(lines: DataFrame, k: int | None = None) -> DataFrame:
    """edge, count of such lines; k is given or stands in the header. A wrong version, length or base stops the job."""
    if k is None:
        head = [r.value for r in lines.where(r"value rlike '^#|^[0-9]+ [0-9]+ [01]$'").collect()]  # the two lines of the header
        about = [h.split() for h in head if not h.startswith("#")]
        if f"#{DUMP_VERSION}" not in head or len(about) != 1:
            raise ValueError(f"no header of version {DUMP_VERSION}: {head[:3]}")
        k = int(about[0][0])
        if int(about[0][1]) != lines.count() - 2:
            raise ValueError(f"the header names {about[0][1]} edges")
    lines = lines.where(r"not value rlike '^#|^[0-9]+ [0-9]+ [01]$'")
    held = lines.select(F.split("value", "\t").alias("p")).select(F.get("p", F.lit(0)).alias("edge"), F.get("p", F.lit(1)).cast("long").alias("count"))
    wrong = F.coalesce((F.length("edge") != k + 1) | ~F.col("edge").rlike("^[ACGT]+$") | F.col("count").isNull(), F.lit(True))
    return held.select(F.when(wrong, F.raise_error(F.concat(F.lit("bad edge: "), F.coalesce("edge", F.lit("null"))))).otherwise(F.col("edge")).alias("edge"), "count")


def set_text(kmer_set: DataFrame, k: int | None = None) -> DataFrame:
    """value: the k-mers in order; with k, after lines of the dump's version, and of k and the number of k-mers."""
    lines = kmer_set.select(F.lit(1).alias("part"), F.col("kmer").alias("value"))
    if k is not None:
        head = kmer_set.sparkSession.createDataFrame([(-1, f"#{DUMP_VERSION}"), (0, f"{k} {kmer_set.count()}")], "part int, value string")
        lines = head.unionByName(lines)
    return lines.orderBy("part", "value").select("value")


def dot_text(edges: DataFrame, k: int, scale: str = "const", show_counts: bool = True, collapse: bool = False, label_nodes: bool = True) -> DataFrame:
    """value: the lines of a GraphViz digraph's edges; width by const, linear, sqrt or log of the count; linear paths as one edge if asked."""
    if collapse:
        from strandlake.operators.compact import segments

        held = segments(edges).select(F.expr(f"left(head, {k})").alias("src"), F.expr(f"right(last, {k})").alias("dst"), F.col("mean_count").alias("count"))
    else:
        from strandlake.operators.graph import with_nodes

        held = with_nodes(edges).select("src", "dst", "count")
    width = {"const": F.lit(1.0), "linear": F.col("count").cast("double"), "sqrt": F.sqrt("count"), "log": F.log1p("count")}[scale]
    label = F.concat(F.lit(' label="'), F.col("count").cast("string"), F.lit('"')) if show_counts else F.lit("")
    name = (lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))) if label_nodes else (lambda c: F.concat(F.lit("n"), F.crc32(F.col(c).cast("binary")).cast("string")))
    return held.select(F.concat(name("src"), F.lit(" -> "), name("dst"), F.lit(" [penwidth="), F.format_number(width, 3), label, F.lit("];")).alias("value"))


def superdot_text(segs: DataFrame, k: int, colour: str = "black", shape: str = "point", label_nodes: bool = False, label_edges: bool = True) -> DataFrame:
    """value: a GraphViz digraph of unbranched paths, in order: the nodes where they begin and end, then each path with its id, the rank of its first edge."""
    from strandlake.operators.compact import rank_of

    held = segs.select("head", F.expr(f"left(head, {k})").alias("src"), F.expr(f"right(last, {k})").alias("dst"))
    held = held.join(rank_of(held, "head").withColumnRenamed("id", "at"), "head")
    drawn = F.lit(f'" fontcolor="{colour}"color="{colour}"];')
    nodes = held.select(F.explode(F.array("src", "dst")).alias("name")).distinct().select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), "name")
    nodes = nodes.withColumn("value", F.concat(F.lit("\t"), "name", F.lit(f' [shape="{shape}", label="'), F.concat(F.lit(" "), F.col("name")) if label_nodes else F.lit(""), drawn))
    label = F.concat(F.lit(" "), F.col("at").cast("string")) if label_edges else F.lit("")
    paths = held.select(F.lit(2).alias("part"), "at", F.lit("").alias("name"), F.concat(F.lit("\t"), "src", F.lit(" -> "), "dst", F.lit(' [label="'), label, drawn).alias("value"))
    frame = segs.sparkSession.createDataFrame([(0, 0, "", "digraph {"), (3, 0, "", "}")], "part int, at long, name string, value string")
    return frame.unionByName(nodes).unionByName(paths).orderBy("part", "at", "name").select("value")
