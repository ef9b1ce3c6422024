"""Mixtures with errors, majority paths, reads written by class, headers of dumps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph, kmerset, spectrum
from strandlake.sources import reads as R
from tests.test_sequence import as_dict, dna, table


def test_a_planted_mixture_is_found_within_its_errors(spark):
    rnd, rows, true = random.Random(2), [], {"a": 500, "b": 300, "c": 150, "d": 50}
    for g, n in true.items():
        for _ in range(n):
            read, kind = len(rows), rnd.random()
            other = rnd.choice([x for x in true if x != g])
            # a third are of one gene, a third leave two open, the others lean a little to the wrong one
            rows.append([(read, g, 0.1)] if kind < 0.34 else [(read, g, 1.0), (read, other, 1.0)] if kind < 0.67 else [(read, g, 1.5), (read, other, 1.2)])
    scored = spark.createDataFrame([x for r in rows for x in r], "read_id long, gene string, score double")
    lengths = spark.createDataFrame([("a", 100), ("b", 200), ("c", 50), ("d", 400)], "gene string, length long")
    got = {r.gene: r for r in spectrum.mixture(scored, lengths, replicates=12).collect()}
    p = dict.fromkeys(true, 1.0)
    for _ in range(5000):
        new = dict.fromkeys(true, 0.0)
        for r in rows:
            t = sum(p[g] * math.exp(-s) for _, g, s in r)
            for _, g, s in r:
                new[g] += p[g] * math.exp(-s) / t
        done, p = max(abs(new[g] - p[g]) for g in p) < 1e-9, new
        if done:
            break
    for g, n in true.items():
        assert got[g]["count"] == pytest.approx(p[g], abs=0.1)
        assert 0 < got[g].count_error < 60 and abs(got[g]["count"] - n) <= 3 * got[g].count_error
        # at least what counting alone would leave open
        assert got[g].count_error > 0.4 * math.sqrt(n * (1000 - n) / 1000)
    assert got["a"].fpkm == pytest.approx(got["a"]["count"] * 1e9 / (100 * 1000)) and got["a"].fpkm_error == pytest.approx(got["a"].count_error * 1e9 / (100 * 1000))
    assert spectrum.mixture(scored.limit(0), lengths, replicates=2).count() == 0


def test_majority_paths_are_walked_step_by_step(spark):
    k, seqs = 7, [dna(910, 120)] * 3 + [dna(910, 60) + dna(911, 60), "ACGTTGCA" * 6]
    edges = graph.build(table(spark, *seqs), k)
    counts = as_dict(edges)
    best = {}
    for e, n in sorted(counts.items()):
        if e[:k] not in best or n > counts[best[e[:k]]]:
            best[e[:k]] = e
    begins = [seqs[0][:k], seqs[0][50 : 50 + k], seqs[-1][:k], seqs[0][-k:], "A" * k]
    for length in (3, 30, 100):
        got = {r.node: r.seq for r in graph.majority_path(edges, spark.createDataFrame([(b,) for b in begins], "node string"), length).collect()}
        for b in begins:
            seq = b
            while len(seq) < length and seq[-k:] in best:
                seq += best[seq[-k:]][-1]
            assert got[b] == seq


def test_reads_are_written_by_class_with_their_mates(spark, tmp_path):
    rnd = random.Random(5)
    for m in (1, 2):
        (tmp_path / f"m{m}.fq").write_text("".join(f"@r{i}/{m}\n{dna(i * 2 + m, 20)}\n+\n{'I' * 20}\n" for i in range(60)))
    both = [R.numbered(R.read_fastq(spark, str(tmp_path / f"m{m}.fq"))).withColumn("read_id", F.col("ordinal")).withColumn("mate", F.lit(m)) for m in (1, 2)]
    names = {i: rnd.choice(["graft", "host", None]) for i in range(60)}
    classes = spark.createDataFrame([(i, c) for i, c in names.items() if c], "read_id long, cls string")
    R.save_by_class(both[0].unionByName(both[1]), classes, str(tmp_path / "out"), mate="mate")
    for c in ("graft", "host", "none"):
        sides = []
        for m in (1, 2):
            files = sorted((tmp_path / "out" / f"cls={c}" / f"mate={m}").glob("part-*"))
            lines = "".join(f.read_text() for f in files).splitlines()
            assert lines[1::4] == [dna(int(x[2:].split("/")[0]) * 2 + m, 20) for x in lines[::4]]
            sides.append([x[2:].split("/")[0] for x in lines[::4]])
        assert sides[0] == sides[1] and {int(x) for x in sides[0]} == {i for i, n in names.items() if (n or "none") == c}


def test_set_dumps_have_headers(spark):
    held = kmerset.build(table(spark, dna(5, 60)), 11)
    lines = [r.value for r in R.set_text(held, 11).collect()]
    assert lines[:2] == ["#1", f"11 {held.count()}"] and lines[2:] == sorted(r.kmer for r in held.collect()) == [r.value for r in R.set_text(held).collect()]
