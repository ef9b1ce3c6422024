"""Path compaction: maximal unbranched paths of a graph, contigs and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import packed
from strandlake.functions.seq import canonical, kmers, reverse_complement
from strandlake.operators import fragments
from strandlake.operators.components import tied
from strandlake.operators.graph import degrees, stored, with_nodes
from strandlake.sources.staging import free, staged


def previous_edges(edges: DataFrame) -> DataFrame:
    """edge, count, prev: the edge before, where source and walk are unbranched; null at the heads of segments."""
    held = with_nodes(edges)
    plain = degrees(edges).where("n_in = 1 and n_out = 1").select("node")
    into = held.select(F.col("dst").alias("node"), F.col("edge").alias("prev")).join(plain, "node", "left_semi")
    return held.join(into, held["src"] == into["node"], "left").select("edge", "count", "prev")


def edge_size(edges: DataFrame) -> int:
    """Bases of an edge, 0 without edges."""
    if getattr(edges, "codes", None) is not None:
        return edges.size
    row = edges.select(F.length("edge").alias("n")).first()
    return row.n if row else 0


def positions(edges: DataFrame) -> DataFrame:
    """edge, count, head, pos: the segment's first edge and the place in it from 0.

    Edges of up to 31 bases are put together packed, see fragments.py; the result has then the ``pieces`` it is made of
    as an attribute, and says in ``mirrored`` whether both strands of each edge are sure to be there.
    """
    size = edge_size(edges)
    if not 2 <= size <= 31:
        return positions_by_edges(edges)
    if not getattr(edges, "staged_at", None):
        edges = stored(edges)
    held = fragments.pieces(edges, size, positions_by_edges)
    out = fragments.exploded(held, size)
    out.pieces, out.size, out.mirrored = held, size, getattr(edges, "codes", None) is not None
    return out


def positions_by_edges(edges: DataFrame) -> DataFrame:
    """The same, edge by edge.

    Pointer doubling: after round r an edge knows its 2**r-th predecessor, so rounds number the
    logarithm of the longest path; each is one equi-join. A pure cycle begins with its edge that is least
    on both strands; the other strand's cycle ends with that edge's reverse complement.
    """
    before = staged(previous_edges(edges), "previous")
    placed, loops = _doubled(before)
    if loops is None:
        return placed
    ring = staged(before.join(loops, "edge", "left_semi"), "rings")
    ties = tied(ring.select(F.col("edge").alias("a"), F.col("prev").alias("b")))
    home = ring.join(ties.select(F.col("a").alias("edge"), F.col("b").alias("ring")), "edge", "left").select("edge", "prev", F.coalesce("ring", "edge").alias("ring"))
    first = home.groupBy("ring").agg(F.min(F.struct(canonical("edge").alias("c"), "edge")).alias("m")).select("ring", "m.c", "m.edge")
    heads = first.where("edge = c").select("edge").unionByName(home.join(first.where("edge <> c").select(F.col("edge").alias("prev")), "prev", "left_semi").select("edge"))
    cut = ring.join(heads.withColumn("begins", F.lit(True)), "edge", "left").select("edge", "count", F.when(F.col("begins").isNull(), F.col("prev")).alias("prev"))
    return placed.unionByName(_doubled(cut)[0])


def _doubled(before: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edge, count, head, pos of edges on paths; edge of those on pure cycles, None without any) of edge, count, prev."""
    begins = F.col("prev").isNull()
    state = staged(before.select("edge", "count", F.col("prev").alias("jump"), F.when(begins, F.lit(0)).otherwise(1).cast("long").alias("pos"), F.when(begins, F.col("edge")).alias("head")), "segments")
    open_before = None
    while True:
        left = state.where("jump is not null").count()
        if not left or left == open_before:
            placed = state.where("head is not null").select("edge", "count", "head", "pos")
            return placed, state.where("head is null").select("edge") if left else None
        open_before = left
        ahead = state.select(F.col("edge").alias("jump"), F.col("jump").alias("far"), F.col("pos").alias("more"), F.col("head").alias("found"))
        moved = state.where("jump is not null").join(ahead, "jump").select("edge", "count", F.col("far").alias("jump"), (F.col("pos") + F.col("more")).alias("pos"), F.col("found").alias("head"))
        old, state = state, staged(state.where("jump is null").unionByName(moved), "segments")
        free(old)


#: Places of a path that are gathered together before its sequence is put together from such pieces.
PIECE = 4096


def segments(edges: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """head, last, length (edges), mean_count (rounded), min_count, first_count, last_count, total, seq of each unbranched path."""
    placed = positions(edges) if placed is None else placed
    if getattr(placed, "pieces", None) is not None:
        return _segments(placed)
    at = F.col("pos") - F.col("piece") * PIECE
    pieces = placed.withColumn("piece", F.expr(f"pos div {PIECE}")).groupBy("head", "piece").agg(
        F.count("*").alias("length"), F.sum("count").alias("total"), F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"), F.min("count").alias("min_count"), F.max("count").alias("max_count"),
        F.max_by("edge", "pos").alias("last"), F.min_by("count", "pos").alias("first_count"), F.max_by("count", "pos").alias("last_count"),
        F.array_sort(F.collect_list(F.struct(at.alias("pos"), F.substring("edge", -1, 1).alias("b")))).alias("bases"),
    )
    pieces = pieces.withColumn("bases", F.array_join(F.transform("bases", lambda b: b["b"]), ""))
    grouped = pieces.groupBy("head").agg(
        F.sum("length").alias("length"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("min_count").alias("min_count"), F.max("max_count").alias("max_count"),
        F.max_by("last", "piece").alias("last"), F.min_by("first_count", "piece").alias("first_count"), F.max_by("last_count", "piece").alias("last_count"),
        F.array_sort(F.collect_list(F.struct("piece", "bases"))).alias("bases"),
    )
    mean = F.col("total") / F.col("length")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("length") - mean * mean))
    seq = F.concat(F.expr("left(head, length(head) - 1)"), F.array_join(F.transform("bases", lambda b: b["bases"]), ""))
    return grouped.select("head", "last", "length", F.round(mean).cast("long").alias("mean_count"), "min_count", "max_count", spread.alias("sd_count"), "first_count", "last_count", "total", seq.alias("seq"))


def _segments(placed: DataFrame) -> DataFrame:
    """The same of pieces, which are dealt once by path and joined in two steps."""
    blocks = fragments.measured(placed.pieces, placed.size).repartition("head").groupBy("head", F.expr(f"at div {16 * PIECE}").alias("block")).agg(
        *(F.sum(c).alias(c) for c in ("length", "total", "squares")), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("last", "at").alias("last"),
        F.min_by("first_count", "at").alias("first_count"), F.max_by("last_count", "at").alias("last_count"), F.array_sort(F.collect_list(F.struct("at", "bases"))).alias("bases"),
    )
    blocks = blocks.withColumn("bases", F.array_join(F.transform("bases", lambda b: b["bases"]), ""))
    grouped = blocks.groupBy("head").agg(
        *(F.sum(c).alias(c) for c in ("length", "total", "squares")), F.min("low").alias("min_count"), F.max("high").alias("max_count"), F.max_by("last", "block").alias("last"),
        F.min_by("first_count", "block").alias("first_count"), F.max_by("last_count", "block").alias("last_count"), F.array_sort(F.collect_list(F.struct("block", "bases"))).alias("bases"),
    )
    mean = F.col("total") / F.col("length")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("length") - mean * mean))
    seq = F.concat(F.expr("left(head, length(head) - 1)"), F.array_join(F.transform("bases", lambda b: b["bases"]), ""))
    held = grouped.withColumn("head", packed.unpack("head", placed.size)).withColumn("last", packed.unpack("last", placed.size))
    return held.select("head", "last", "length", F.round(mean).cast("long").alias("mean_count"), "min_count", "max_count", spread.alias("sd_count"), "first_count", "last_count", "total", seq.alias("seq"))


def segment_ends(segs: DataFrame, s: str = "s", t: str = "t") -> DataFrame:
    """node, n_in, n_out of the nodes where segments begin and end: no edge but their first and last ones touches these."""
    ends = segs.select(F.col(s).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(segs.select(F.col(t).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def entry_edges(segs: DataFrame) -> DataFrame:
    """seg_id, edge, length, mean_count, rc_seg_id: ids are ranks of first edges; the other strand's path begins with the reverse complement of the last edge."""
    ranked = segs.select("head", "last", "length", "mean_count")
    ids = rank_of(ranked.select("head"), "head")
    own = ranked.join(ids, "head")
    other = ids.select(F.col("head").alias("rc_head"), F.col("id").alias("rc_seg_id"))
    return own.withColumn("rc_head", reverse_complement("last")).join(other, "rc_head", "left").select(F.col("id").alias("seg_id"), F.col("head").alias("edge"), "length", "mean_count", "rc_seg_id")


def rank_of(df: DataFrame, column: str) -> DataFrame:
    """column and id: its rank from 0. Range partitions are numbered on their own; one row a partition says what lies ahead."""
    held = df.select(column).repartitionByRange(column).sortWithinPartitions(column).withColumn("at", F.monotonically_increasing_id())
    held = staged(held.select(column, F.shiftright("at", 33).alias("part"), F.expr("at & ((1L << 33) - 1)").alias("at")), "ranks")
    sizes = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("ahead"))
    return held.join(F.broadcast(sizes), "part").select(column, (F.col("ahead") + F.col("at")).alias("id"))  # one row a partition


def contigs(edges: DataFrame, k: int, min_length: int = 0, min_coverage: int = 0, both_strands: bool = False, linear_segments: bool = False) -> DataFrame:
    """contig_id, seq, length, min_coverage, max_coverage, mean_coverage, sd_coverage of each path, once for both strands.

    Where a path ends at a shared node, only the strand on which that node is canonical keeps its k bases,
    unless linear_segments asks for whole segments.
    """
    segs = staged(segments(edges).withColumn("s", F.expr(f"left(head, {k})")).withColumn("t", F.expr(f"right(last, {k})")), "contigs")
    ends = segment_ends(segs)
    first, last = ends.select(F.col("node").alias("s"), F.col("n_in").alias("s_in")), ends.select(F.col("node").alias("t"), F.col("n_out").alias("t_out"))
    held = segs.join(first, "s").join(last, "t")
    if not both_strands:
        held = held.where(F.col("head") <= reverse_complement("last"))
    if not linear_segments:
        left = F.when((F.col("s_in") == 0) | (F.col("s") <= reverse_complement("s")), 0).otherwise(k)
        right = F.when((F.col("t_out") == 0) | (F.col("t") > reverse_complement("t")), 0).otherwise(k)
        held = held.withColumn("seq", F.substring("seq", left + 1, F.greatest(F.lit(0), F.length("seq") - left - right)))
    held = held.where((F.length("seq") >= min_length) & (F.length("seq") > 0) & (F.col("min_count") >= min_coverage))
    ids = rank_of(held.select("head"), "head")
    return held.join(ids, "head").select(F.col("id").alias("contig_id"), "seq", F.length("seq").cast("long").alias("length"), F.col("min_count").alias("min_coverage"), F.col("max_count").alias("max_coverage"), (F.col("total") / held["length"]).alias("mean_coverage"), F.col("sd_count").alias("sd_coverage"))


def components(edges: DataFrame, reads: DataFrame | None = None, k: int | None = None, seq: str = "seq") -> DataFrame:
    """node, component: the least node that edges lead to in either direction; restricted to edges of the reads if given."""
    if reads is not None:
        hit = kmers(reads, k + 1, seq).select(F.explode(F.array("kmer", reverse_complement("kmer"))).alias("edge")).distinct()
        edges = edges.join(hit, "edge", "left_semi")
    held = with_nodes(edges).select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    nodes = held.select(F.col("a").alias("node")).unionByName(held.select(F.col("b").alias("node"))).distinct()
    return nodes.join(tied(held).select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """component_stats() of components(edges). Paths are tied by their ends, so nodes within are not dealt."""
    placed = positions(edges)
    if getattr(placed, "pieces", None) is None:
        return component_stats(edges, components(edges))
    sums = (*(F.sum(c).alias(c) for c in ("length", "total", "squares")), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"))
    paths = fragments.measured(placed.pieces, placed.size).groupBy("head").agg(*sums, F.max_by("last", "at").alias("last"))
    paths = staged(paths.withColumn("s", F.shiftright("head", 2)).withColumn("t", F.col("last").bitwiseAND(F.lit(4 ** (placed.size - 1) - 1))), "paths")
    held = paths.join(tied(paths.select(F.col("s").alias("a"), F.col("t").alias("b"))).select(F.col("a").alias("s"), "b"), "s", "left").groupBy(F.coalesce("b", "s").alias("root")).agg(*sums)
    mean = F.col("total") / F.col("length")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("length") - mean * mean))
    return held.select(packed.unpack("least", placed.size - 1).alias("component"), F.col("length").alias("size"), F.col("low").alias("min_count"), F.col("high").alias("max_count"), mean.alias("mean_count"), spread.alias("sd_count"))


def component_stats(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """component, size (edges), min_count, max_count, mean_count, sd_count."""
    held = with_nodes(edges).join(labelled, F.col("src") == F.col("node"))
    return held.groupBy("component").agg(F.count("*").alias("size"), F.min("count").alias("min_count"), F.max("count").alias("max_count"), F.avg("count").alias("mean_count"), F.stddev_pop("count").alias("sd_count"))


def largest_component(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """The edges of the component with most edges, the first by label of equals, and their other strand."""
    top = component_stats(edges, labelled).orderBy(F.desc("size"), "component").limit(1).select("component")
    chosen = with_nodes(edges).join(labelled.join(top, "component", "left_semi"), F.col("src") == F.col("node")).select("edge")
    both = chosen.unionByName(chosen.select(reverse_complement("edge").alias("edge"))).distinct()
    return edges.join(both, "edge", "left_semi")
