"""Reads with planted substitutions, insertions and deletions against the true sequence; alignments against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import compact, correct, graph, supergraph
from strandlake.sources.staging import staged
from tests.test_sequence import dna, rc, table


def worn(genome, edits):
    """The genome with edits {place: what stands for the base there}."""
    return "".join(edits.get(i, x) for i, x in enumerate(genome))


def other(x):
    return rc(x)


K = 13
A, B, C, D = dna(81, 600), dna(82, 300), dna(83, 500), dna(85, 400)
B2 = worn(B, {150: other(B[150])})  # another arm
THIRD = next(x for x in "ACGT" if x not in (B[150], B2[150]))
CHANCE = D[:200] + dna(86, 3) + D[200:]


def planted():
    """Copies of A with bases changed, left out and put in, and what was planted."""
    rnd, reads = random.Random(5), []
    for _ in range(12):
        edits = {}
        for p in [p for p in range(30, 560, 40) if rnd.random() < 0.7]:
            edits[p] = rnd.choice([other(A[p]), "", A[p] + rnd.choice("ACGT"), A[p] + rnd.choice("ACGT") + rnd.choice("ACGT")])
            if edits[p] == "" and rnd.random() < 0.5:
                edits[p + 1] = ""
        reads.append(worn(A, edits))
    return reads


FOREIGN = C[:100] + dna(84, 40) + C[140:300]
SHUFFLED = C[:151] + C[400:414] + C[165:300]  # amid the right bases a window from elsewhere
PLAIN = ["", C[:9], C[:200], None, dna(95, 60)]


@pytest.fixture(scope="module")
def made(spark):
    """(edges, read -> row of thread_spans) of all cases, mended in one run."""
    # the last of these has a window of CHANCE over its insertion, which no walk joins with the rest
    edges = staged(graph.build(table(spark, A, B, B2, C, D, dna(87, 6) + CHANCE[194:208] + dna(88, 6)), K), "edges")
    reads = planted() + [rc(planted()[0]), worn(B, {140: ""}), worn(B2, {140: "", 159: other(B[159])}), worn(B, {150: THIRD}), worn(B, {60: B[60] + "A"}), FOREIGN, SHUFFLED, CHANCE, *PLAIN]
    rows = correct.thread_spans(table(spark, *reads), edges, K).collect()
    return edges, {reads[r.read_id]: r for r in rows}


def test_planted_indels_are_mended(made):
    got = made[1]
    assert [got[x].seq for x in planted()] == [A] * 12 and got[rc(planted()[0])].seq == rc(A)
    assert all(got[x].n_edits >= got[x].n_spans > 0 for x in planted())


def test_walks_over_several_paths_and_ties(made):
    """Two genomes differ at one base: reads are mended over the fork to the nearer arm; one between both is left as it is."""
    got = made[1]
    assert got[worn(B, {140: ""})].seq == B and got[worn(B2, {140: "", 159: other(B[159])})].seq == B2
    assert got[worn(B, {60: B[60] + "A"})].seq == B
    tie = got[worn(B, {150: THIRD})]
    assert (tie.seq, tie.n_spans) == (worn(B, {150: THIRD}), 0)


def test_chance_hits_foreign_spans_and_plain_reads(made):
    got = made[1]
    assert (got[FOREIGN].seq, got[FOREIGN].n_spans) == (FOREIGN, 0) and (got[SHUFFLED].seq, got[SHUFFLED].n_spans) == (SHUFFLED, 0)
    assert (got[CHANCE].seq, got[CHANCE].n_spans, got[CHANCE].n_edits) == (D, 1, 3)
    assert [(got[x].seq, got[x].n_spans) for x in PLAIN] == [(x, 0) for x in PLAIN]


def test_mending_ends_with_substitutions(spark, made):
    read = worn(C[:150], {4: other(C[4]), 70: ""})
    got = correct.mend_reads(table(spark, read, dna(95, 60)), made[0].join(table(spark, C).select(F.explode(F.expr(f"transform(sequence(1, length(seq) - {K}), i -> substring(seq, i, {K + 1}))")).alias("edge")), "edge", "left_semi"), K)
    assert {r.read_id: (r.seq, r.n_spans, r.n_edits, r.n_fixed) for r in got.collect()} == {0: (C[:150], 1, 1, 1), 1: (dna(95, 60).lower(), 0, 0, 0)}


def test_empty_tables(spark, made):
    assert correct.thread_spans(table(spark, "").where("false"), made[0], K).count() == 0
    assert correct.thread_spans(table(spark, dna(2, 50)), made[0].where("false"), K).first().seq == dna(2, 50)


def test_alignments_equal_a_plain_walk(spark):
    k, a = 13, dna(91, 200)
    edges = graph.build(table(spark, a, a[:80] + dna(92, 60)), k)
    paths = supergraph.superpaths(compact.segments(edges), k)
    reads = [a[20:150], rc(a[100:180]), a[10:60] + dna(93, 7) + a[60:75] + a[10:40], dna(94, 40), ""]
    got = supergraph.alignments(supergraph.align_reads(table(spark, *reads), supergraph.edge_index(edges), k), paths, k)
    seqs = {r.path: r.seq for r in paths.collect()}
    rows = got.collect()
    for r in rows:
        piece, there = reads[r.read_id][r.read_begin : r.read_end], seqs[r.path][r.path_begin : r.path_end]
        assert piece == (there if r.forward else rc(there)) and r.n_edges == len(piece) - k
    covered = {(r.read_id, p) for r in rows for p in range(r.read_begin, r.read_end - k)}
    held = {r.edge for r in edges.collect()}
    assert covered == {(i, p) for i, s in enumerate(reads) for p in range(len(s) - k) if s[p : p + k + 1] in held}
    assert len(covered) == sum(r.n_edges for r in rows) and not got.where(F.col("read_id") > 2).count()
    assert set(supergraph.tables(paths, paths.select(F.col("path").alias("lhs"), F.col("path").alias("rhs"), F.lit(1).alias("n"), F.lit(0.0).alias("gap")), got)) == {"nodes", "links", "sequences", "alignments"}
