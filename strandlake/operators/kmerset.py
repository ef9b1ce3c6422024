"""K-mer sets and their algebra. A set is a DataFrame with one column ``kmer`` of distinct canonical k-mers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.seq import canonical, kmers
from strandlake.sources.staging import staged


def build(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    return kmers(reads, k, seq).select(canonical("kmer").alias("kmer")).distinct()


def check_k(*sets: DataFrame) -> int | None:
    """The common k of the sets that have rows; an error if they differ."""
    found = {r.k for s in sets for r in s.select(F.length("kmer").alias("k")).limit(1).collect()}
    if len(found) > 1:
        raise ValueError(f"sets of different k: {sorted(found)}")
    return next(iter(found), None)


def merge(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def intersect(*sets: DataFrame, skip_empty: bool = False) -> DataFrame:
    """K-mers of every set; with skip_empty, sets without rows are passed over."""
    held = [s for s in sets if not (skip_empty and s.isEmpty())]
    if not held:
        return sets[0]
    return reduce(DataFrame.unionByName, held).groupBy("kmer").count().where(F.col("count") == len(held)).select("kmer")


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "kmer", "left_anti")


def with_prefix(kmer_set: DataFrame, prefixes: DataFrame, length: int) -> DataFrame:
    """The k-mers that begin with one of the prefixes, all of that length. prefixes: prefix, repeated or not."""
    return kmer_set.join(prefixes.select("prefix"), F.substring("kmer", 1, length) == F.col("prefix"), "left_semi")


def annotate(left: DataFrame, right: DataFrame) -> DataFrame:
    """kmer, in_lhs, in_rhs over the union."""
    both = left.select("kmer", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("kmer", F.lit(False).alias("l"), F.lit(True).alias("r")))
    return both.groupBy("kmer").agg(F.max("l").alias("in_lhs"), F.max("r").alias("in_rhs"))


def neighbours(kmer_set: DataFrame, k: int) -> DataFrame:
    """The canonical k-mers one substitution away from each, with the k-mer's other columns."""
    held = kmer_set.withColumn("__at", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("__base", F.explode(F.array(*map(F.lit, "ACGT"))))
    held = held.where(F.expr("substring(kmer, __at, 1) <> __base"))
    return held.withColumn("kmer", canonical(F.expr("concat(left(kmer, __at - 1), __base, substring(kmer, __at + 1))"))).drop("__at", "__base")


def mark_near(annotated: DataFrame, k: int) -> DataFrame:
    """Clears both flags of k-mers of one side only that have a neighbour of the other side only.

    Decided on the flags as given. Being neighbours is mutual, so only the smaller side is expanded, and
    each match marks both of its ends.
    """
    annotated = staged(annotated, "annotated")
    sides = annotated.where(F.col("in_lhs") != F.col("in_rhs"))
    told = sides.agg(F.count_if("in_lhs").alias("l"), F.count_if("in_rhs").alias("r")).first()
    small, large = ("in_lhs", "in_rhs") if told.l <= told.r else ("in_rhs", "in_lhs")
    facing = neighbours(sides.where(small).select("kmer", F.col("kmer").alias("origin")), k)
    near = facing.join(sides.where(large).select("kmer"), "kmer").select(F.explode(F.array("kmer", "origin")).alias("kmer")).distinct()
    held = annotated.join(near.withColumn("near", F.lit(True)), "kmer", "left")
    flag = F.coalesce("near", F.lit(False))
    return held.select("kmer", (F.col("in_lhs") & ~flag).alias("in_lhs"), (F.col("in_rhs") & ~flag).alias("in_rhs"))


def from_graph(edges: DataFrame) -> DataFrame:
    """The canonical edges of a graph as a set."""
    return edges.where(F.col("edge") == canonical("edge")).select(F.col("edge").alias("kmer"))
