import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import packed
from strandlake.functions import seq as S
from strandlake.operators import classify, graph, kmerset, spectrum


def texts(n, size, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(40)]
    return [" ".join(r.choice(words) for _ in range(size)) + r.choice(["", " ÉK", "\n\n7"]) for _ in range(n)] + ["", "ab"]


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, text string")


def both(df):
    """The reads as sequences, and as small letters."""
    return df.select("read_id", S.dna_of_text("text").alias("seq")), df.select("read_id", F.lower("text").alias("seq"))


def windows_in_plan(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Generate explode(transform" in plan


def test_masks_of_codes_equal_those_of_strings(spark, monkeypatch):
    (reads, letters), (left, left_letters), (right, right_letters) = (both(table(spark, texts(n, 30, seed))) for n, seed in ((40, 1), (5, 1), (6, 2)))
    k = 11
    index = classify.two_genome_index(kmerset.build(left, k), kmerset.build(right, k), k)
    codes = classify.two_genome_codes(*(packed.distinct(x, k, table=packed.LETTERS) for x in (left_letters, right_letters)), k)
    assert sorted(map(tuple, packed.unpacked(codes.select("in_lhs", "in_rhs", "code"), k).select("kmer", "in_lhs", "in_rhs").collect())) == sorted(map(tuple, index.collect()))
    found = classify.hits(reads, index, k).groupBy("read_id").agg(F.bit_or(F.expr("shiftleft(1, 2 * cast(in_lhs as int) + cast(in_rhs as int))")).alias("m"))
    want = {r.read_id: 0 for r in reads.collect()} | {r.read_id: r.m for r in found.collect()}
    assert len(set(want.values())) > 2
    for few in (1 << 20, 10):  # sent to every task, mapped from files
        monkeypatch.setattr(packed, "FEW", few)
        held = classify.read_masks(letters, codes, k, letters=packed.LETTERS)
        assert {r.read_id: r.mask for r in held.collect()} == want
        assert not windows_in_plan(held)  # windows don't become rows
        assert {r.read_id: r.mask for r in classify.read_masks(reads, index, k).collect()} == want


def test_lca_of_codes_equals_that_of_strings(spark):
    reads, letters = both(table(spark, texts(30, 30, 3)))
    paths = spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, [0, 2]), (3, [0, 1, 3]), (4, [0, 1, 4]), (5, [0, 2, 5]), (9, [9])], "node int, path array<int>")
    nodes = F.element_at(F.array(*map(F.lit, (3, 4, 5, 1, 9))), (F.col("read_id") % 5 + 1).cast("int"))
    want = classify.annotate_lca(reads.select(nodes.alias("node"), "seq"), paths, 9)
    got = classify.annotate_lca_codes(letters.select(nodes.alias("node"), "seq"), paths, 9, letters=packed.LETTERS)
    assert sorted(map(str, packed.unpacked(got.select("node", "code"), 9).select("kmer", "node").collect())) == sorted(map(str, want.collect()))
    a, b = classify.classify_taxa(reads, want, paths, 9), classify.classify_taxa(letters, got, paths, 9, letters=packed.LETTERS)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and not windows_in_plan(b)


def test_matching_looks_up_packed_kmers(spark):
    reads, letters = both(table(spark, texts(30, 30, 5)))
    told, _ = both(table(spark, texts(2, 12, 5)))
    for k in (25, 12, 31, 33):
        held = kmerset.build(told, k)
        want = {r.read_id for r in classify.hits(reads, held, k).collect()}
        got = classify.matching(letters, held, k, letters=packed.LETTERS)
        assert {r.read_id for r in got.collect()} == want and windows_in_plan(got) == (k > 31)


def test_sample_sets_as_bits_and_as_codes(spark):
    reads, letters = both(table(spark, texts(30, 30, 6)))
    name = (F.col("read_id") % 3).cast("string")
    sample = F.when(name != "2", name).alias("sample")
    for k in (6, 9, 12, 14):
        want = S.kmers(reads.select(sample, "seq"), k, keep=("sample",)).select("sample", S.canonical("kmer").alias("kmer")).distinct()
        got = spectrum.incidence(letters.select(sample, "seq"), k, letters=packed.LETTERS)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not windows_in_plan(got)


def test_prefixes_are_looked_at_before_kmers_are_dealt(spark):
    reads, letters = both(table(spark, texts(20, 30, 7)))
    prefixes = spark.createDataFrame([("ACG",), ("AAT",)], "prefix string")
    want = kmerset.with_prefix(kmerset.build(reads, 25), prefixes, 3)
    got = packed.unpacked(packed.distinct(letters, 25, table=packed.LETTERS, prefixes=prefixes.select(packed.code_of("prefix").alias("code")), length=3), 25)
    assert want.count() and sorted(got.collect()) == sorted(want.collect())


def test_pair_measures(spark):
    reads, letters = both(table(spark, [*texts(20, 30, 8), "aaaa", "aeaeae", "x", "zzz", "a" * 300_000 + "b"]))
    want = reads.where("read_id <> 26").select("read_id", S.entropy1("seq").alias("entropy"), S.period2_share("seq").alias("period2"))
    got = {r.read_id: (r.entropy, r.period2) for r in packed.pair_measures(letters, "read_id").collect()}
    assert all(np.allclose(got[r.read_id], (r.entropy, r.period2), atol=1e-12) for r in want.collect())
    assert got[26][1] == 299_998 / 299_999  # a step for each base, not for each pair of them


def test_trim_relative_keeps_a_count_that_equals_the_share(spark):
    edges = spark.createDataFrame([("ACC", 51), ("ACG", 99), ("GGT", 51), ("CGT", 99)], "edge string, count long")
    assert 0.34 * 150 > 51  # as floating-point numbers; 0.34 times 150 is 51
    assert {r.edge for r in graph.trim_relative(edges, 0.34).collect()} == {"ACC", "ACG", "GGT", "CGT"}
    assert {r.edge for r in graph.trim_relative(edges, 0.35).collect()} == {"ACG", "CGT"}
