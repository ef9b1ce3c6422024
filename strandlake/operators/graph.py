"""De Bruijn count graphs: ``edge`` (k+1 bases, both strands stored) and ``count``."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import packed
from strandlake.functions.seq import canonical, kmers, reverse_complement, source_node, target_node
from strandlake.sources.staging import staged


def build(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Counts of all (k+1)-mers of both strands. Canonical edges are counted once and mirrored, so half is shuffled; palindromes count twice."""
    if k + 1 <= 31:
        return from_codes(packed.counts(reads, k + 1, seq), k + 1)
    one = kmers(reads, k + 1, seq).select(canonical("kmer").alias("edge")).groupBy("edge").agg(F.count("*").alias("n"))
    other = reverse_complement("edge")
    strands = F.when(F.col("edge") == other, F.array(F.struct("edge", (2 * F.col("n")).alias("count")))).otherwise(F.array(F.struct("edge", F.col("n").alias("count")), F.struct(other.alias("edge"), F.col("n").alias("count"))))
    return one.select(F.explode(strands).alias("s")).select("s.edge", "s.count")


def from_codes(codes: DataFrame, size: int) -> DataFrame:
    """The graph of packed canonical edges of size bases (code, n, own): it has ``codes`` and ``size`` as attributes, from which operators may read it."""

    def strands(batches):
        for batch in batches:
            code, n, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            code, n = np.concatenate((code, packed.other_strand(code[~own], size))), np.concatenate((np.where(own, 2 * n, n), n[~own]))
            yield pa.RecordBatch.from_arrays([packed.letters_of(code, size), pa.array(n)], ["edge", "count"])

    # Spark's estimate of its size is too low by far, so no join may send it to every task for that
    held = codes.select("code", "n", "own").mapInArrow(strands, "edge string, count long").hint("merge")
    held.codes, held.size = codes, size
    return held


def stored(edges: DataFrame, name: str = "graph") -> DataFrame:
    """edges, written once; packed where they are packed."""
    if getattr(edges, "codes", None) is None:
        return staged(edges, name)
    codes = staged(edges.codes, name)
    held = from_codes(codes, edges.size)
    held.staged_at = codes.staged_at
    return held


def merge(*graphs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, graphs).groupBy("edge").agg(F.sum("count").alias("count"))


def with_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("edge", "count", source_node("edge").alias("src"), target_node("edge").alias("dst"))


def histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("count").alias("multiplicity")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out."""
    held = with_nodes(edges)
    ends = held.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(held.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def trim(edges: DataFrame, cutoff: int | None = None, scale_by_k: float | None = None, k: int | None = None) -> DataFrame:
    """Edges with a count above the cutoff; without one it is inferred from the histogram (1 if that fails)."""
    if cutoff is None:
        from strandlake.functions.stats import infer_cutoff

        # a row for each distinct multiplicity: of n windows at most the square root of 2 n
        cutoff = infer_cutoff([(r.multiplicity, r.n) for r in histogram(edges).collect()]) or 1
    if scale_by_k and k:
        cutoff = cutoff * scale_by_k / k
    if getattr(edges, "codes", None) is not None:
        return from_codes(edges.codes.where(F.col("n") * F.when(F.col("own"), 2).otherwise(1) > cutoff), edges.size)
    return edges.where(F.col("count") > cutoff)


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those in gone and their reverse complements."""
    both = gone.select("edge").unionByName(gone.select(reverse_complement("edge").alias("edge"))).distinct()
    return edges.join(both, "edge", "left_anti")


def trim_relative(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """Drops, with its other strand, each edge below a share of the counts that leave its source, where several leave.

    The share is taken as the decimal number it is written as, so a count that equals it stays.
    """
    leaving = Window.partitionBy("src")
    held = with_nodes(edges).withColumn("total", F.sum("count").over(leaving)).withColumn("n", F.count("*").over(leaving))
    least = F.lit(Decimal(repr(share))) * F.col("total").cast("decimal(19,0)")
    return without(edges, held.where((F.col("n") > 1) & (F.col("count").cast("decimal(19,0)") < least)))


def lint(edges: DataFrame) -> DataFrame:
    """edge, problem: edges whose other strand is absent or has another count."""
    # Spark's estimate is of what the edges are made of: too little for either side to be sent to every task by it
    other = edges.select(reverse_complement("edge").alias("edge"), F.col("count").alias("other")).hint("merge")
    problem = F.when(F.col("other").isNull(), "no reverse complement").when(F.col("other") != F.col("count"), "counts differ")
    return edges.join(other, "edge", "left").select("edge", problem.alias("problem")).where("problem is not null")


def detect_variants(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Target edges that the reference lacks, from nodes that some reference edge leaves."""
    known = reference.select(source_node("edge").alias("src")).distinct()
    fresh = with_nodes(target).join(reference.select("edge"), "edge", "left_anti")
    return fresh.join(known, "src", "left_semi").select("edge", "count")


def majority_edge(edges: DataFrame) -> DataFrame:
    """node, edge, count: the edge of highest count that leaves each node, the first in order of equals."""
    best = with_nodes(edges).groupBy("src").agg(F.min(F.struct((-F.col("count")).alias("c"), "edge")).alias("b"))
    return best.select(F.col("src").alias("node"), "b.edge", (-F.col("b.c")).alias("count"))


def majority_path(edges: DataFrame, begins: DataFrame, length: int) -> DataFrame:
    """node, seq: from each node of begins along the edges of highest count, up to length bases or where nothing leaves.

    Every node has one such edge at most, so steps are doubled: a table tells where 1, 2, 4, ... steps lead,
    and each begin takes those that its number of steps is made of. A begin that the graph doesn't have has itself as seq.
    """
    hop = majority_edge(edges).select(F.col("node").alias("at"), F.expr("substring(edge, 2)").alias("to"), F.expr("right(edge, 1)").alias("bases"))
    out = begins.select("node").distinct().select("node", F.col("node").alias("seq"), F.col("node").alias("at"), F.greatest(F.lit(0), F.lit(length) - F.length("node")).alias("left"))
    steps = 1
    while not (out := staged(out, "majority")).where(f"left >= {steps}").isEmpty():
        hop = staged(hop, "hops")
        # bit by bit from the lowest: a path is the same whichever of its hops come first
        odd = f"(left div {steps}) % 2 = 1"
        moved = out.where(odd).join(hop, "at", "left").select("node", F.concat("seq", F.coalesce("bases", F.lit(""))).alias("seq"), F.col("to").alias("at"), "left")
        out = out.where(f"not ({odd})").unionByName(moved)
        far = hop.select(F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("bases").alias("more"))
        hop = hop.join(far, "to", "left").select("at", F.col("beyond").alias("to"), F.concat("bases", F.coalesce("more", F.lit(""))).alias("bases"))
        steps *= 2
    return out.select("node", "seq")


def with_reference_counts(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """Edges of both graphs with the reference's counts."""
    return reference.join(edges.select("edge"), "edge", "left_semi")


def subgraph(edges: DataFrame, reads: DataFrame, k: int, radius: int = 1, linear_paths: bool = False, seq: str = "seq") -> DataFrame:
    """Edges of the reads and all within radius steps, on both strands; with linear_paths, whole segments."""
    hit = kmers(reads, k + 1, seq).select(F.explode(F.array("kmer", reverse_complement("kmer"))).alias("edge")).distinct()
    chosen = edges.join(hit, "edge", "left_semi")
    for _ in range(radius):
        held = with_nodes(chosen)
        ends = held.select(F.col("src").alias("node")).unionByName(held.select(F.col("dst").alias("node"))).distinct()
        near = with_nodes(edges)
        grown = near.join(ends, near["src"] == ends["node"], "left_semi").unionByName(near.join(ends, near["dst"] == ends["node"], "left_semi")).select("edge", "count")
        chosen = staged(grown.distinct(), "subgraph")
    if linear_paths:
        from strandlake.operators.compact import positions

        place = positions(edges)
        wanted = place.join(chosen.select("edge"), "edge", "left_semi").select("head").distinct()
        chosen = chosen.unionByName(edges.join(place.join(wanted, "head", "left_semi").select("edge"), "edge", "left_semi")).distinct()
    return chosen


def profile_distances(samples: DataFrame) -> DataFrame:
    """i, j, distance: Euclidean distance of the samples' normalised counts. samples: sample, edge, count.

    From dot products over shared edges, so edges of one sample only are not expanded.
    """
    total = samples.groupBy("sample").agg(F.sum("count").alias("total"))
    p = samples.join(total, "sample").select("sample", "edge", (F.col("count") / F.col("total")).alias("p"))
    squares = p.groupBy("sample").agg(F.sum(F.col("p") * F.col("p")).alias("s"))
    a, b = p.select(F.col("sample").alias("i"), "edge", F.col("p").alias("x")), p.select(F.col("sample").alias("j"), "edge", F.col("p").alias("y"))
    dots = a.join(b, "edge").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    si, sj = squares.select(F.col("sample").alias("i"), F.col("s").alias("si")), squares.select(F.col("sample").alias("j"), F.col("s").alias("sj"))
    pairs = si.join(sj, F.col("i") < F.col("j")).join(dots, ["i", "j"], "left")
    return pairs.select("i", "j", F.sqrt(F.greatest(F.lit(0.0), F.col("si") + F.col("sj") - 2 * F.coalesce("dot", F.lit(0.0)))).alias("distance"))


def error_minimum(edges: DataFrame) -> DataFrame:
    """minimum, mean_count: the first local minimum of the coverage histogram by central differences, and the mean count (without the last bucket)."""
    h = histogram(edges)
    order = Window.orderBy("multiplicity")
    slopes = h.withColumn("d", F.lead("n").over(order) - F.lag("n").over(order)).withColumn("last", F.lead("n").over(order).isNull())
    low = slopes.where("d >= 0").agg(F.min("multiplicity").alias("minimum"))
    mean = slopes.where("not last").agg((F.sum(F.col("multiplicity") * F.col("n")) / F.sum("n")).alias("mean_count"))
    return low.withColumn("one", F.lit(1)).join(mean.withColumn("one", F.lit(1)), "one").drop("one")  # one row each

