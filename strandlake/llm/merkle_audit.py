"""Operator 1: Merkle fixity audit of archived records.

The records of a volume are hashed, ordered ranges of offsets become the leaves of a tree, and each
node's hash covers those of its children. Two replicas are compared root first; only the children of
nodes that differ are looked at on the next level, down to the records that are altered, missing or
extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stage, table

#: Offsets in a leaf's range and children of a node.
SPAN, FANOUT = 64, 16


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of a response record as text: version, named fields, an empty line, the block, two line ends."""
    block = F.coalesce(body, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string")]
    return F.concat(*head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def fixity(records: DataFrame) -> DataFrame:
    """volume, offset, n, fix, sha256 of each offset. records: volume, offset long, record (string or binary).

    Equal records of an offset are counted, not gathered, and different ones are combined by XOR over
    their digests with counts, so no offset needs its rows in one place. A null offset counts as -1, a
    null volume as '', a null record as empty.
    """
    rows = records.select(
        F.coalesce(F.col("volume").cast("string"), F.lit("")).alias("volume"),
        F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.sha2(F.coalesce(F.col("record").cast("binary"), F.lit("").cast("binary")), 256).alias("sha256"),
    )
    counted = rows.groupBy("volume", "offset", "sha256").agg(F.count("*").alias("n"))
    salted = counted.withColumn("d", F.sha2(F.concat_ws(":", "sha256", F.col("n").cast("string")).cast("binary"), 256))
    words = [F.bit_xor(F.conv(F.substring("d", 1 + 16 * k, 16), 16, -10).cast("long")).alias(f"x{k}") for k in range(4)]
    held = salted.groupBy("volume", "offset").agg(F.sum("n").alias("n"), *words, F.min("sha256").alias("sha256"))
    return held.select("volume", "offset", "n", F.sha2(F.concat_ws(":", *[F.col(f"x{k}").cast("string") for k in range(4)]).cast("binary"), 256).alias("fix"), "sha256")


def tree(fixed: DataFrame, levels: int, span: int = SPAN, fanout: int = FANOUT) -> list[DataFrame]:
    """Leaves first: volume, node, hash of each level. A node has at most span offsets or fanout children, by construction."""
    label = F.concat_ws(":", F.col("offset").cast("string"), "fix")
    leaves = fixed.withColumn("node", F.expr(f"offset div {span}")).groupBy("volume", "node").agg(F.array_sort(F.collect_list(label)).alias("parts"))
    out = [stage(leaves.select("volume", "node", F.sha2(F.array_join("parts", ",").cast("binary"), 256).alias("hash")), "op1-leaves")]
    for _ in range(levels):
        label = F.concat_ws(":", F.col("node").cast("string"), "hash")
        above = out[-1].groupBy("volume", F.expr(f"node div {fanout}").alias("up")).agg(F.array_sort(F.collect_list(label)).alias("parts"))
        out.append(stage(above.select("volume", F.col("up").alias("node"), F.sha2(F.array_join("parts", ",").cast("binary"), 256).alias("hash")), "op1-level"))
    return out


def audit(source: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """volume, offset, status (altered, missing, extra), source_sha256, replica_sha256 of each offset that differs.

    Both: volume, offset, record; see fixity() for nulls and repeated rows. Where an offset holds several
    records the least digest is reported. Equal replicas, two empty tables among them, give no rows.
    """
    a, b = (stage(fixity(x), "op1-fixity") for x in (source, replica))
    ends = a.unionByName(b).agg(F.min("offset").alias("low"), F.max("offset").alias("high")).first()
    reach, levels = max(abs(ends.low or 0), abs(ends.high or 0)) // span, 0
    while reach:
        reach, levels = reach // fanout, levels + 1
    left, right = tree(a, levels, span, fanout), tree(b, levels, span, fanout)
    wrong = None
    for level in range(levels, -1, -1):
        x, y = left[level].withColumnRenamed("hash", "h1"), right[level].withColumnRenamed("hash", "h2")
        if wrong is not None:
            up = wrong.withColumnRenamed("node", "up")
            x, y = (t.withColumn("up", F.expr(f"node div {fanout}")).join(up, ["volume", "up"], "left_semi").drop("up") for t in (x, y))
        wrong = stage(x.join(y, ["volume", "node"], "full").where(~F.col("h1").eqNullSafe(F.col("h2"))).select("volume", "node"), "op1-wrong")
    x, y = (t.withColumn("node", F.expr(f"offset div {span}")).join(wrong, ["volume", "node"], "left_semi") for t in (a, b))
    both = x.select("volume", "offset", F.col("fix").alias("f1"), F.col("sha256").alias("source_sha256")).join(y.select("volume", "offset", F.col("fix").alias("f2"), F.col("sha256").alias("replica_sha256")), ["volume", "offset"], "full")
    status = F.when(F.col("f2").isNull(), "missing").when(F.col("f1").isNull(), "extra").otherwise("altered")
    return both.where(~F.col("f1").eqNullSafe(F.col("f2"))).select("volume", "offset", status.alias("status"), "source_sha256", "replica_sha256")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages as bit rot and lost or stray writes leave it: bodies altered, rows gone, rows added, by rules on page_id."""
    kept = pages.where(F.col("page_id").isNull() | (F.col("page_id") % 211 != 7))
    kept = kept.withColumn("html", F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    stray = pages.where(F.col("page_id") % 503 == 5).withColumn("page_id", F.col("page_id") + 1_000_000_000)
    return kept.unionByName(stray)


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")

    def records(p: DataFrame) -> DataFrame:
        return p.select(F.lit("pages").alias("volume"), F.col("page_id").alias("offset"), warc_record(F.col("url"), F.col("html")).alias("record"))

    return audit(records(pages), records(damaged(pages))).select(F.col("offset").alias("page_id"), "status", "source_sha256", "replica_sha256")


#: DuckDB SQL for the rows of op1_fixity.
OP1_SQL = """
WITH r AS (
  SELECT page_id, url, html FROM pages WHERE page_id % 211 <> 7
  UNION ALL SELECT page_id + 1000000000, url, html FROM pages WHERE page_id % 503 = 5
), replica AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND page_id < 1000000000 THEN '~' || substr(html, 2) ELSE html END AS html FROM r
), a AS (
  SELECT page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10)) AS s FROM pages
), b AS (
  SELECT page_id, sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10)) AS s FROM replica
)
SELECT page_id, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'extra' ELSE 'altered' END AS status,
       a.s AS source_sha256, b.s AS replica_sha256
FROM a FULL JOIN b USING (page_id) WHERE a.s IS DISTINCT FROM b.s
"""
