"""Reads against reference k-mer sets: selection, masks, two-genome classes, taxonomy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import packed
from strandlake.functions.seq import canonical, dna_of_text, kmers
from strandlake.operators import kmerset
from strandlake.operators.compact import rank_of
from strandlake.operators.membership import probable
from strandlake.sources.staging import mapped_path, staged

#: Class and confidence of each of the 16 masks (bits: 8 both, 4 left, 2 right, 1 marginal).
MASKS = [
    (0, "neither", "definite"), (1, "both", "probable"), (2, "right", "definite"), (3, "right", "probable"),
    (4, "left", "definite"), (5, "left", "probable"), (6, "ambiguous", "definite"), (7, "ambiguous", "probable"),
    (8, "both", "definite"), (9, "both", "probable"), (10, "right", "definite"), (11, "right", "probable"),
    (12, "left", "definite"), (13, "left", "probable"), (14, "ambiguous", "definite"), (15, "ambiguous", "probable"),
]
#: What all k-mers of an index may take, counted with so many bytes a row beside their bases, to be sent to every task.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
CLASSES = ("left", "right", "both", "neither", "ambiguous")


def hits(reads: DataFrame, index: DataFrame, k: int, key: str = "read_id", seq: str = "seq") -> DataFrame:
    """key, kmer and the index's other columns for each window of a read, on either strand, whose k-mer the index has.

    index: kmer (distinct), other columns. It is written once. Where all its k-mers are few enough to be sent
    to every task, others are dropped by them where they arise, else by a filter; so only hits or likely ones are dealt by k-mer.
    """
    index = staged(index, "index")
    rows, told = index.count(), index.select("kmer")
    held = kmers(reads, k, seq, keep=(key,)).select(key, canonical("kmer").alias("kmer"))
    if rows * (k + ROW_BYTES) > BROADCAST_BYTES:
        held = held.where(probable(told, rows)(F.col("kmer"))).join(index, "kmer")
    else:
        held = held.join(F.broadcast(told), "kmer", "left_semi")
        held = held if index.columns == ["kmer"] else held.join(index, "kmer")
    return held.select(key, "kmer", *(c for c in index.columns if c != "kmer"))


def hit_values(reads: DataFrame, index: DataFrame, k: int, value: Column, key: str = "read_id", seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """key, value (whole numbers from 0) for the k-mers of a read that the index has, on either strand; each at least once.

    index: kmer or code (as packed k-mers), distinct, other columns. Of up to 31 bases k-mers are looked up packed where
    they arise, in a table that every task has or maps, so no k-mer is dealt; else those of hits() are taken.
    """
    if k <= 31:
        index = staged(index.select((F.col("code") if "code" in index.columns else packed.code_of("kmer")).alias("code"), value.cast("long").alias("value")), "index")
        table = packed.lookup(index, k, lambda: mapped_path(reads.sparkSession, "lookup"))
        if table is not None:
            return packed.found(reads, table, k, key, seq, letters)
        index, value = index.select(packed.unpack("code", k).alias("kmer"), "value"), F.col("value")
    elif "code" in index.columns:
        raise ValueError("codes are of 31 bases at most")
    reads = reads if letters is packed.CODES else reads.withColumn(seq, dna_of_text(seq))
    return hits(reads, index.select("kmer", value.cast("long").alias("value")), k, key, seq).select(key, "value")


def matching(reads: DataFrame, kmer_set: DataFrame, k: int, key: str = "read_id", seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """Keys of reads with a k-mer of the set, on either strand."""
    return hit_values(reads, kmer_set, k, F.lit(0), key, seq, letters).select(key).distinct()


def filter_reads(reads: DataFrame, kmer_set: DataFrame, k: int, key: str = "read_id", seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """reads with a column matched. Mates that share a key are matched together."""
    hit = matching(reads, kmer_set, k, key, seq, letters).withColumn("matched", F.lit(True))
    return reads.join(hit, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def extract_reads(reads: DataFrame, edges: DataFrame, k: int, key: str = "read_id", seq: str = "seq") -> DataFrame:
    """Reads that have an edge of the graph."""
    return reads.join(matching(reads, kmerset.from_graph(edges), k + 1, key, seq), key, "left_semi")


def reference_masks(references: DataFrame, k: int, key: str = "ref", seq: str = "seq") -> DataFrame:
    """kmer, masks: for each k-mer an array of (word, mask); bit i of word w stands for reference number 64 w + i. Any number of references."""
    held = kmers(references, k, seq, keep=(key,)).select(canonical("kmer").alias("kmer"), F.expr(f"{key} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({key} % 64 as int))").alias("bit"))
    held = held.groupBy("kmer", "word").agg(F.bit_or("bit").alias("mask"))
    return held.groupBy("kmer").agg(F.collect_list(F.struct("word", "mask")).alias("masks"))


def select_by_references(reads: DataFrame, masks: DataFrame, k: int, threshold: int, key: str = "read_id", seq: str = "seq") -> DataFrame:
    """key, masks, refs, matched: the references that share a k-mer with the read, as (word, mask) in order, their number, and whether it reaches the threshold."""
    words = hits(reads, masks, k, key, seq).select(key, F.explode("masks").alias("m")).groupBy(key, "m.word").agg(F.bit_or("m.mask").alias("mask"))
    found = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("masks"), F.sum(F.bit_count("mask")).alias("refs"))
    held = reads.select(key).distinct().join(found, key, "left")
    return held.select(key, F.coalesce("masks", F.expr("cast(array() as array<struct<word: bigint, mask: bigint>>)")).alias("masks"), F.coalesce("refs", F.lit(0)).cast("long").alias("refs")).withColumn("matched", F.col("refs") >= threshold)


def two_genome_index(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """kmer, in_lhs, in_rhs of both sets, with k-mers one substitution from the other side's marked as of neither."""
    return kmerset.mark_near(kmerset.annotate(left, right), k)


def two_genome_codes(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """code, in_lhs, in_rhs: the same of sets of packed k-mers (code)."""
    both = left.select("code", F.lit(2).alias("side")).unionByName(right.select("code", F.lit(1).alias("side")))
    side = F.bit_or("side").alias("side")
    held = staged(both.groupBy("code").agg(side), "annotated")
    told = held.agg(F.count_if(F.col("side") == 2).alias("l"), F.count_if(F.col("side") == 1).alias("r")).first()
    small, large = (2, 1) if told.l <= told.r else (1, 2)

    def around(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy()
            for at in range(0, len(codes), 1 << 14):
                some = codes[at : at + (1 << 14)]
                there = (some[:, None, None] ^ (np.arange(1, 4)[None, None, :] << 2 * np.arange(k, dtype=np.int64)[None, :, None])).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(packed.canonical_codes(there, k)), pa.array(np.repeat(some, 3 * k))], ["code", "origin"])

    facing = held.where(F.col("side") == small).select("code").mapInArrow(around, "code long, origin long")
    met = facing.join(held.where(F.col("side") == large).select("code"), "code").select(F.explode(F.array("code", "origin")).alias("code"))
    near = staged(met.distinct(), "near").withColumn("near", F.lit(True))
    marked = held.join(near, "code", "left").withColumn("side", F.when(F.col("near"), 0).otherwise(F.col("side")))
    return marked.select("code", (F.col("side") >= 2).alias("in_lhs"), (F.col("side") % 2 == 1).alias("in_rhs"))


def read_masks(reads: DataFrame, index: DataFrame, k: int, key: str = "read_id", seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """key, mask of each read; pairs share a key. index: kmer or code, in_lhs, in_rhs."""
    value = F.expr("2 * cast(in_lhs as int) + cast(in_rhs as int)")
    found = hit_values(reads, index, k, value, key, seq, letters).groupBy(key).agg(F.bit_or(F.expr("shiftleft(1, cast(value as int))")).alias("mask"))
    return reads.select(key).distinct().join(found, key, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def classified(masks: DataFrame) -> DataFrame:
    """Adds cls and confidence from the table of masks."""
    names, sure = (F.array(*[F.lit(m[i]) for m in MASKS]) for i in (1, 2))
    return masks.withColumn("cls", F.get(names, F.col("mask"))).withColumn("confidence", F.get(sure, F.col("mask")))


def mask_counts(masks: DataFrame) -> DataFrame:
    """mask, n over all 16 masks."""
    every = masks.sparkSession.range(16).select(F.col("id").cast("int").alias("mask"))
    return every.join(masks.groupBy("mask").agg(F.count("*").alias("n")), "mask", "left").select("mask", F.coalesce("n", F.lit(0)).alias("n"))


def class_summary(masks: DataFrame) -> DataFrame:
    """cls, n, percent over the five classes."""
    every = masks.sparkSession.createDataFrame([(c,) for c in CLASSES], "cls string")
    counts = classified(masks).groupBy("cls").agg(F.count("*").alias("n"))
    held = every.join(counts, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return held.withColumn("percent", F.when(total > 0, 100.0 * F.col("n") / total).otherwise(F.lit(0.0)))


# ---- taxonomy: node, path (ids from the root to the node)


def common_prefix(paths):
    """The longest common prefix of an array of paths, as SQL over the column's name."""
    return F.expr(f"aggregate({paths}, {paths}[0], (a, b) -> slice(a, 1, coalesce(array_min(filter(sequence(0, least(size(a), size(b))), i -> i = least(size(a), size(b)) or a[i] <> b[i])), 0)))")


def annotate_lca_codes(references: DataFrame, paths: DataFrame, k: int, seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """code, node: what annotate_lca() tells, of packed k-mers.

    What the paths of a set of taxa share is what the first and the last of them share in the paths' order, so of each
    k-mer two ranks are kept. paths: one row a node.
    """
    ranks = staged(paths.join(rank_of(paths.select("path").distinct(), "path"), "path").select("node", "path", F.col("id").alias("rank")), "ranks")
    held = packed.windows(references.join(ranks.select("node", "rank"), "node"), k, "rank", seq, letters)
    held = staged(held.groupBy("code").agg(F.min("rank").alias("a"), F.max("rank").alias("z")), "lca")
    first, last = (ranks.groupBy("rank").agg(F.first("path").alias(p)).select(F.col("rank").alias(c), p) for c, p in (("a", "p0"), ("z", "p1")))
    pairs = held.select("a", "z").distinct().join(first, "a").join(last, "z").select("a", "z", F.array("p0", "p1").alias("paths"))
    pairs = pairs.select("a", "z", common_prefix("paths").alias("p")).select("a", "z", F.expr("case when size(p) > 0 then element_at(p, -1) end").alias("node"))
    return held.join(staged(pairs, "pairs"), ["a", "z"]).select("code", "node")


def annotate_lca(references: DataFrame, paths: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, node: the lowest common ancestor of the taxa whose references have the k-mer (null if none). references: node, seq."""
    held = kmers(references, k, seq, keep=("node",)).select(canonical("kmer").alias("kmer"), "node").distinct()
    held = held.join(paths, "node").groupBy("kmer").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return held.select("kmer", common_prefix("paths").alias("p")).select("kmer", F.expr("case when size(p) > 0 then element_at(p, -1) end").alias("node"))


def subtree_totals(annotated: DataFrame, paths: DataFrame) -> DataFrame:
    """node, own, total: k-mers at a node and in the subtree below."""
    own = annotated.where("node is not null").groupBy("node").agg(F.count("*").alias("own"))
    spread = own.join(paths, "node").select(F.explode("path").alias("node"), "own").groupBy("node").agg(F.sum("own").alias("total"))
    return spread.join(own, "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"), "total")


def classify_taxa(reads: DataFrame, annotated: DataFrame, paths: DataFrame, k: int, key: str = "read_id", seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """key, node: the most specific taxon of reads whose hits all lie on one line from the root; others are left out."""
    numbers = staged(rank_of(paths.select("node").distinct(), "node"), "numbers")
    held = annotated.where("node is not null").join(numbers, "node")
    found = hit_values(reads, held, k, F.col("id"), key, seq, letters).distinct().join(numbers, F.col("value") == F.col("id")).select(key, "node").join(paths, "node")
    grouped = found.groupBy(key).agg(F.collect_set("path").alias("paths"), F.max_by("path", F.size("path")).alias("deep"))
    line = F.expr("forall(paths, p -> p = slice(deep, 1, size(p)))")
    return grouped.where(line).select(key, F.element_at("deep", -1).alias("node"))
