import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import clean, compact, fragments, graph
from strandlake.sources.staging import staged


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def reads_of(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")


RING = dna(90, 4)
CASES = {
    "branches": (8, [dna(400, 1), dna(200, 1) + dna(150, 2), dna(60, 3)] * 2),
    "rings": (12, [RING + RING[:12], dna(100, 5), "A" * 40]),
    "even": (5, [dna(300, 6)]),
        "long": (30, [dna(300, 8), dna(150, 8) + "T" + dna(100, 9)]),
}


@pytest.mark.parametrize("name", CASES)
def test_positions_equal_those_edge_by_edge(spark, name, monkeypatch):
    k, seqs = CASES[name]
    edges = graph.build(reads_of(spark, *seqs), k)
    plain = staged(edges.select("edge", "count"), "plain")
    assert getattr(edges, "codes", None) is not None and getattr(plain, "codes", None) is None
    want = sorted(map(tuple, compact.positions_by_edges(plain).select("edge", "count", "head", "pos").collect()))
    counted = S.kmers(reads_of(spark, *seqs), k + 1).select(F.explode(F.array("kmer", S.reverse_complement("kmer"))).alias("edge")).groupBy("edge").count()
    assert sorted(map(tuple, counted.collect())) == sorted((e, n) for e, n, _, _ in want)
    monkeypatch.setattr(fragments, "MESSAGE", 7 if name == "even" else fragments.MESSAGE)
    by_edges = compact.segments(plain, spark.createDataFrame(want, "edge string, count long, head string, pos long"))
    for g in (edges, plain)[: 2 if name == "rings" else 1]:
        placed = compact.positions(g)
        assert sorted(map(tuple, placed.select("edge", "count", "head", "pos").collect())) == want
        assert sorted(map(tuple, compact.segments(g, placed).select(by_edges.columns).collect())) == sorted(map(tuple, by_edges.collect()))
    assert placed.pieces.count() < len(want)  # what is joined over all tasks is fragments, not edges
    if name != "branches":
        return
    label = {(r.component, r.size, r.min_count, r.max_count, round(r.mean_count, 9), round(r.sd_count, 6)) for r in compact.component_sizes(edges).collect()}
    assert label == {(r.component, r.size, r.min_count, r.max_count, round(r.mean_count, 9), round(r.sd_count, 6)) for r in compact.component_stats(plain, compact.components(plain)).collect()}
    for f in (clean.prune_tips, clean.trim_paths, clean.clip_links):
        assert sorted(f(edges, k).collect()) == sorted(f(plain, k).collect())


def test_graphs_with_one_strand_only(spark):
    edges = spark.createDataFrame([(dna(60, 11)[i : i + 9], 1 + i % 3) for i in range(52)], "edge string, count long")
    a, b = compact.positions(edges), compact.positions_by_edges(edges)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect()) and not a.mirrored
    assert clean.trim_paths(edges, 26).count() == 0


def test_lint_does_not_send_a_graph_to_every_task(spark):
    edges = graph.build(reads_of(spark, dna(400, 12)), 15)
    plan = graph.lint(edges.where("not startswith(edge, 'AC')"))._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
