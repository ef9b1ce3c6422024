"""Abundance by expectation maximisation against the same rounds in plain Python, and where it leads."""

import random

import pytest

from strandlake.operators import spectrum


def by_force(hits, lengths, rounds):
    held = {}
    for read, gene, n in hits:
        held.setdefault(read, []).append((n, gene))
    held = {r: [g for n, g in x if n == max(x)[0]] for r, x in held.items()}
    share = dict.fromkeys({g for gs in held.values() for g in gs}, 1.0)
    for _ in range(rounds):
        new = dict.fromkeys(share, 0.0)
        for gs in held.values():
            total = sum(share[g] for g in gs)
            for g in gs:
                new[g] += share[g] / total
        share = new
    return {g: (p, p * 1e9 / (lengths[g] * len(held))) for g, p in share.items()}


def found(spark, hits, lengths, rounds):
    told = spark.createDataFrame(hits, "read_id long, gene string, n long")
    return {r.gene: (r["count"], r.fpkm) for r in spectrum.abundance(told, spark.createDataFrame(list(lengths.items()), "gene string, length long"), rounds).collect()}


def test_rounds_equal_plain_ones(spark):
    rnd = random.Random(5)
    lengths = {f"g{i}": rnd.randint(50, 900) for i in range(6)}
    hits = [(r, g, rnd.randint(1, 3)) for r in range(120) for g in rnd.sample(sorted(lengths), rnd.randint(1, 4))]
    got, want = found(spark, hits, lengths, 7), by_force(hits, lengths, 7)
    assert got.keys() == want.keys()
    for g, v in want.items():
        assert got[g] == pytest.approx(v)


def test_shared_reads_follow_unique_ones(spark):
    """30 and 10 reads are one gene's alone, 40 fit both: they go three to one. A worse hit counts for nothing."""
    hits = [(i, "a", 5) for i in range(30)] + [(i, "b", 5) for i in range(30, 40)]
    hits += [(i, g, 5) for i in range(40, 80) for g in "ab"] + [(0, "c", 4)]
    got = found(spark, hits, {"a": 100, "b": 100, "c": 100}, 20)
    assert got["a"][0] == pytest.approx(60, abs=0.01) and got["b"][0] == pytest.approx(20, abs=0.01) and "c" not in got
    assert found(spark, hits[:0], {"a": 100}, 3) == {}
