"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandlake.sources.staging import free, freed_shuffles, staged


def tied(edges: DataFrame, name: str = "ties") -> DataFrame:
    """a, b: b is the least member of a's component, for all members but the least.

    edges: a, b of one type with an order, in any direction, repeated or not; loops and nulls are passed
    over. Large-star ties every node's larger neighbours to its least one, small-star its smaller ones,
    so even long paths collapse in a number of rounds that is logarithmic in practice. Each half round is
    an aggregation with map-side combine and a join, and is written to the shared folder. The least
    neighbours are written before the large join, so that Spark may split a node with very many edges.
    """

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        """The table and a fingerprint of its rows, from one pass. A task that is run again can only make it differ, which costs a round."""
        seen = Observation()
        held = staged(ordered(e).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), name)
        return held, seen.get

    ties, before = written(edges)
    while before["n"]:
        with freed_shuffles(edges.sparkSession):
            both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), name)
            large = staged(ordered(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), name)
            down = large.groupBy("a").agg(F.min("b").alias("m"))
            small, after = written(large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))))
            free(ties, low, large)
        ties = small
        if after == before:
            break
        before = after
    return ties


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component. edges as tied() takes them."""
    ties = tied(edges, name)
    roots = ties.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = staged(ties.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), name)
    free(ties)
    return out
