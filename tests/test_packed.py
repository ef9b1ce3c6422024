"""Packed k-mers against the counts of plain windows."""

import collections

import pytest

from strandlake.functions import packed
from strandlake.operators import graph
from tests.test_sequence import dna, rc, table, windows


@pytest.mark.parametrize("k", [1, 2, 6, 7, 24, 25, 31])
def test_slices_equal_windows(monkeypatch, k):
    import pyarrow as pa

    monkeypatch.setattr(packed, "SLICE", 50)
    seqs = [dna(1, 120), None, "", "ACG", dna(2, 40) + "N" + dna(3, 33).lower() + "é" + dna(4, 30), "AT" * 40, dna(5, 31), dna(6, 49) * 2]
    for held in (pa.array(seqs), pa.array(["GGG", *seqs, "CC"]).slice(1, len(seqs))):
        got, own = collections.Counter(), set()
        for codes, n, same in packed._slices(held, k):
            for c, m, s in zip(codes.tolist(), n.tolist(), same.tolist(), strict=True):
                kmer = "".join("ACGT"[c >> 2 * i & 3] for i in range(k - 1, -1, -1))
                got[kmer] += m
                own |= {kmer} if s else set()
        want = collections.Counter(min(w, rc(w)) for s in seqs if s for w in windows(s, k))
        assert got == want and own == {w for w in want if w == rc(w)}


def test_histogram_and_strings(spark):
    reads = table(spark, dna(7, 300), "ACGT" * 20, dna(7, 100), None, "", "AC")
    for k in (7, 12):
        counted = packed.counts(reads, k)
        assert set(packed.histogram(counted).collect()) == set(graph.histogram(graph.build(reads, k - 1)).collect())
        want = {(r.kmer, r.n) for r in graph.build(reads, k - 1).selectExpr("edge as kmer", "count as n").collect()}
        got = counted.select(packed.unpack("code", k).alias("kmer"), "n", "own").collect()
        assert {(x, r.n * (2 if r.own else 1)) for r in got for x in (r.kmer, rc(r.kmer))} == want
    rows = packed.by_prefix(packed.counts(reads, 12), 12, 2).collect()
    every = sorted({min(w, rc(w)) for r in reads.collect() if r.seq for w in windows(r.seq, 12)})
    assert {(r.prefix, r.n, r.low, r.high) for r in rows} == {(p, len(h), h[0], h[-1]) for p in {x[:2] for x in every} if (h := [x for x in every if x[:2] == p])}
    assert packed.counts(reads.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        packed.counts(reads, 32)
