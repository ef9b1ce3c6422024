"""Operator 8: exact deduplication with a log-structured merge index of digests, DataFrame operations only.

Rows fall into memtables as a scan task meets them; each memtable flushes one run, sorted by digest.
Compaction merges some runs into one and keeps the smallest identifier and the number of rows of each
digest, until one run is left. A Bloom filter over the digests that were merged from several rows is
probed by every row before anything moves: rows that it rules out are alone with their text, and only
the bytes of the others, the hits, are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import SPACES, join_hot, probable, stage, table, text_or_empty
from strandlake.sources.staging import free, freed_shuffles

#: Rows of a memtable, and runs at least that one compaction merges.
MEMTABLE_ROWS, FAN_IN = 2_000_000, 8


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def flush(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """doc_id, digest, rid, part, chunk of every row: the sorted runs, one for each memtable of each scan task. Nothing is shuffled."""
    rid = F.monotonically_increasing_id()
    rows = docs.select("doc_id", digest_of(normalised()).alias("digest"), rid.alias("rid"))
    rows = rows.withColumn("part", F.shiftright("rid", 33)).withColumn("chunk", F.expr(f"(rid & ((1L << 33) - 1)) div {memtable_rows}"))
    return stage(rows.sortWithinPartitions("chunk", "digest"), "op8-runs")


def merge_index(runs: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """(digest, keeper (struct of null flag, doc_id, rid), group_size: the run that is left after compaction; the number of rows).

    So many runs are merged at once that two compactions are enough, fan_in at least. Counts and minima
    combine before each shuffle, so a digest that a third of all rows share reaches a task as one row for
    each task before. A run's files are dealt by digest and each is sorted by it.
    """
    told = runs.agg(F.count("*").alias("n"), F.max("part").alias("part"), F.max("chunk").alias("chunk")).first()
    keeper = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")
    left = ((told.chunk or 0) + 1) * ((told.part or 0) + 1)
    fan_in = max(fan_in, int(left**0.5) + 1)
    held = runs.select((F.col("chunk") * F.lit((told.part or 0) + 1) + F.col("part")).alias("run"), "digest", keeper.alias("keeper"), F.lit(1).cast("long").alias("group_size"))
    before = None
    while before is None or left > 1:
        left = -(-left // fan_in)
        merged = held.withColumn("run", F.expr(f"run div {fan_in}")).groupBy("run", "digest")
        held = stage(merged.agg(F.min("keeper").alias("keeper"), F.sum("group_size").alias("group_size")).sortWithinPartitions("run", "digest"), "op8-merged")
        free(before)
        before = held
    return held, told.n


def unequal_hits(docs: DataFrame, hit) -> DataFrame:
    """digest of hits whose texts are not all the same bytes: a digest's least and greatest text, combined before the shuffle, differ.

    The row number keeps the filter above the digest: pushed below, it would compute it for each of its places.
    """
    texts = docs.select(normalised().alias("norm")).select("norm", digest_of(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("at"))
    texts = texts.where(hit(F.col("digest")) & (F.col("at") >= 0))
    ends = texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("z"))
    return ends.where("a <> z").select("digest")


def deduplicate(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty. The row with the smallest doc_id stays, a null doc_id only if the group has no other; of
    repeated rows with that doc_id exactly one is kept. An empty table gives no rows. Should two
    different texts ever share a digest, that digest's rows are grouped by their bytes instead.
    """
    with freed_shuffles(docs.sparkSession):
        runs = flush(docs, memtable_rows)
        index, total = merge_index(runs, fan_in)
        copies = stage(index.where("group_size > 1").select("digest", "keeper", "group_size"), "op8-copies")
        free(index)
        hit = probable(copies.select("digest"), copies.count())
        odd = stage(unequal_hits(docs, hit), "op8-unequal")
        if odd.isEmpty():
            return by_digest(runs, copies, hit, total)
        texts = docs.select("doc_id", normalised().alias("norm")).withColumn("digest", digest_of(F.col("norm")))
        return by_digest(runs.join(odd, "digest", "left_anti"), copies, hit, total).unionByName(by_text(texts.join(odd, "digest", "left_semi")))


def by_digest(runs: DataFrame, copies: DataFrame, hit, total: int) -> DataFrame:
    """The result by digests alone: rows that the filter rules out are alone, the others meet the index, frequent digests by broadcast."""
    alone = runs.where(~hit(F.col("digest"))).withColumn("keeper", F.lit(None).cast(copies.schema["keeper"].dataType)).withColumn("group_size", F.lit(None).cast("long"))
    found = join_hot(runs.where(hit(F.col("digest"))), copies, "digest", "group_size", total, "left")
    single = F.col("group_size").isNull()
    return alone.unionByName(found).select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("keeper.rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def by_text(texts: DataFrame) -> DataFrame:
    """The same from the bytes themselves, for texts whose digests collide."""
    held = stage(texts.withColumn("rid", F.monotonically_increasing_id()), "op8-collided")
    keeper = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")
    groups = held.groupBy("digest", "norm").agg(F.min(keeper).alias("keeper"), F.count("*").alias("group_size"))
    joined = held.select("rid", "doc_id", "digest", "norm").join(groups, ["digest", "norm"])
    return joined.select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keeper.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows repeated with doc_id and text one stays, the first by its columns as JSON.

    Rows whose doc_id no dropped row has stay where they are. The others are told apart by doc_id and
    digest. Nulls, empty tables and other columns are treated as deduplicate() says.
    """
    told = deduplicate(docs)
    gone = stage(told.where("not kept").select("doc_id", F.unhex("text_sha256").alias("digest")).distinct(), "op8-gone")
    stays = told.where("kept and group_size > 1").select("doc_id", F.unhex("text_sha256").alias("digest"))
    twice = stage(stays.join(gone.toDF("id", "d"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left_semi"), "op8-twice")
    ids = gone.select("doc_id")
    maybe = probable(ids, ids.count())(F.col("doc_id"))
    some = docs.where(maybe).select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest_of(normalised()).alias("d"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("d") == F.col("digest"))
    held = docs.where(~maybe).unionByName(some.join(gone, same, "left_anti").select("row.*"))
    if twice.isEmpty():
        return held
    again = some.join(twice, same, "left_semi").groupBy("id", "d").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return held.unionByName(again.select("row.*"))


def op8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of op8_dedup.
OP8_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
