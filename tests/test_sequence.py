"""Sequence operators against golden cases and brute-force models."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.functions import stats
from strandlake.operators import classify, clean, compact, correct, graph, kmerset, scaffold, spectrum, supergraph
from strandlake.sources import reads as R

RC = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x.translate(RC)[::-1]


def dna(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def windows(s, k):
    return [w for i in range(len(s) - k + 1) if set(w := s.upper()[i : i + k]) <= set("ACGT")]


def table(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def edges_by_force(seqs, k):
    c = collections.Counter()
    for s in seqs:
        for w in windows(s, k + 1):
            c[w] += 1
            c[rc(w)] += 1
    return c


def as_dict(df):
    return {r.edge: r["count"] for r in df.collect()}


def test_kmers_break_at_other_letters(spark):
    cases = ["ACGTNACGTAC", "acgtacgt", "", None, "ACG", dna(1, 1000) + "N" + dna(2, 300)]
    got = S.kmers(table(spark, *cases), 5, keep=("read_id",), offsets=True).collect()
    for i, s in enumerate(cases):
        want = [(p, (s or "").upper()[p : p + 5]) for p in range(len(s or "") - 4) if set((s or "").upper()[p : p + 5]) <= set("ACGT")]
        assert sorted((r.pos, r.kmer) for r in got if r.read_id == i) == want
    assert S.kmers(table(spark, *cases), 5).count() == len(got)


def test_goldens(spark):
    assert as_dict(graph.build(table(spark, "A" * 28), 27)) == {"A" * 28: 1, "T" * 28: 1}
    seq = dna(5, 72)
    assert 2 * S.kmers(table(spark, "TTTT", seq), 15).count() == 116
    pal = "ACGT"
    assert as_dict(graph.build(table(spark, pal), 3)) == {"ACGT": 2}


def test_graph_is_symmetric_and_counts_match(spark):
    seqs = [dna(i, 200) for i in range(4)] + [dna(0, 200)[50:150], "acgtn"]
    g = graph.build(table(spark, *seqs), 11)
    assert as_dict(g) == edges_by_force(seqs, 11)
    assert graph.lint(g).count() == 0
    assert as_dict(graph.merge(g, g)) == {e: 2 * n for e, n in edges_by_force(seqs, 11).items()}
    assert graph.lint(g.where(f"edge <> '{windows(seqs[1], 12)[0]}'")).count() == 1
    assert as_dict(R.parse_graph_text(R.graph_text(g), 11)) == as_dict(g)
    with pytest.raises(Exception, match="bad edge"):
        R.parse_graph_text(spark.createDataFrame([("ACGX\t1",)], "value string"), 3).collect()


def test_set_algebra(spark):
    a, b = ([dna(i, 150), dna(9, 60)] for i in (1, 2))
    sa, sb = ({min(w, rc(w)) for s in x for w in windows(s, 13)} for x in (a, b))
    da, db = (kmerset.build(table(spark, *x), 13) for x in (a, b))
    values = lambda df: {r.kmer for r in df.collect()}
    assert values(kmerset.merge(da, db)) == sa | sb
    assert values(kmerset.intersect(da, db)) == sa & sb
    assert values(kmerset.subtract(da, db)) == sa - sb
    none = da.where("false")
    assert values(kmerset.intersect(da, none)) == set() and values(kmerset.intersect(da, none, skip_empty=True)) == sa
    assert {(r.kmer, r.in_lhs, r.in_rhs) for r in kmerset.annotate(da, db).collect()} == {(x, x in sa, x in sb) for x in sa | sb}
    with pytest.raises(ValueError, match="different k"):
        kmerset.check_k(da, kmerset.build(table(spark, *a), 11))


def test_near_kmers_lose_both_flags(spark):
    annotated = spark.createDataFrame([("AACCA", True, False), ("AACCC", False, True), ("ACACA", True, False), ("AAAAA", True, True)], "kmer string, in_lhs boolean, in_rhs boolean")
    got = {r.kmer: (r.in_lhs, r.in_rhs) for r in kmerset.mark_near(annotated, 5).collect()}
    assert got == {"AACCA": (False, False), "AACCC": (False, False), "ACACA": (True, False), "AAAAA": (True, True)}


def segments_by_force(counts, k):
    out, into = collections.defaultdict(list), collections.Counter()
    for e in counts:
        out[e[:k]].append(e)
        into[e[1:]] += 1
    plain = {n for n in out if len(out[n]) == 1 and into[n] == 1}
    found = {}
    for e in counts:
        if e[:k] in plain:
            continue
        path = [e]
        while path[-1][1:] in plain:
            path.append(out[path[-1][1:]][0])
        found[e] = path
    seen = {e for path in found.values() for e in path}
    for e in sorted(counts):  # what is left lies on pure cycles
        if e not in seen:
            path = [e]
            while (after := out[path[-1][1:]][0]) != e:
                path.append(after)
            other = [rc(x) for x in reversed(path)]
            for p in (path, other):
                found[p[0]] = p
                seen |= set(p)
    return found


def test_compaction(spark):
    core = dna(3, 60)
    seqs = [dna(1, 80) + core + dna(2, 80), dna(4, 70) + core + dna(5, 50), dna(6, 40) + rc(core), dna(7, 30) * 3]
    counts = edges_by_force(seqs, 13)
    want = segments_by_force(counts, 13)
    segs = {r.head: r for r in compact.segments(graph.build(table(spark, *seqs), 13)).collect()}
    assert set(segs) == set(want)
    for head, path in want.items():
        assert segs[head].length == len(path) and segs[head].last == path[-1]
        assert segs[head].seq == path[0][:13] + "".join(e[-1] for e in path)
        assert segs[head].min_count == min(counts[e] for e in path)


def test_contigs_of_reads_that_share_nothing(spark):
    half = dna(11, 40)
    seqs = [dna(8, 120), half + rc(half), dna(9, 90)]
    got = {min(r.seq, rc(r.seq)) for r in compact.contigs(graph.build(table(spark, *seqs), 27), 27).collect()}
    assert got == {min(s, rc(s)) for s in seqs}
    assert compact.contigs(graph.build(table(spark, *seqs), 27), 27, min_length=100).count() == 1


def test_components(spark):
    seqs = [dna(i, 60) for i in range(3)] + [dna(0, 60)[20:] + dna(77, 30)]
    g = graph.build(table(spark, *seqs), 15)
    labelled = compact.components(g)
    sizes = sorted(r.size for r in compact.component_stats(g, labelled).collect())
    assert sizes == sorted([75, 75, 45, 45, 45, 45])
    top = compact.largest_component(g, labelled)
    assert top.count() == 150


def test_tips_and_bubbles(spark):
    genome = dna(21, 150)
    changed = genome[:70] + {"A": "C", "C": "G", "G": "T", "T": "A"}[genome[70]] + genome[71:]
    k = 15
    good = {e for e in edges_by_force([genome], k)}
    tip = graph.build(table(spark, *[genome] * 3, changed[45:75]), k)
    assert set(as_dict(clean.prune_tips(tip, k))) == good
    bubble = graph.build(table(spark, *[genome] * 3, changed), k)
    assert set(as_dict(clean.pop_bubbles(bubble, k))) == good
    assert set(as_dict(graph.trim(bubble, 1))) == good
    assert set(as_dict(graph.trim_relative(bubble, 0.3))) == {e for e in as_dict(bubble) if e in good or not ({e[:k], rc(e)[:k]} & {x[:k] for x in good})}
    assert set(as_dict(clean.clip_links(graph.build(table(spark, *[genome] * 4, changed), k), k))) == good


def test_nested_and_triple_bubbles(spark):
    k, a, z = 15, dna(210, 60), dna(211, 60)
    arms = [dna(212, 31)] + [dna(213, 31)]
    near = arms[1][:15] + {"A": "C", "C": "G", "G": "T", "T": "A"}[arms[1][15]] + arms[1][16:]
    g = graph.build(table(spark, *[a + arms[0] + z] * 4, *[a + arms[1] + z] * 2, a + near + z), k)
    want = {e for e in edges_by_force([a + arms[0] + z, a + arms[1] + z], k)}
    assert set(as_dict(clean.pop_bubbles(g, k, max_length=60))) == want


def test_pure_cycles_are_segments(spark):
    ring, k = dna(77, 40), 13
    seqs = [ring + ring[: k], dna(78, 60), "A" * 30]
    g = graph.build(table(spark, *seqs), k)
    segs = compact.segments(g).collect()
    edges = as_dict(g)
    assert sum(r.length for r in segs) == len(edges)
    for r in segs:
        assert all(r.seq[i : i + k + 1] in edges for i in range(r.length)) and r.seq[-k - 1 :] == r.last
    heads = {r.head for r in segs}
    assert all(rc(r.last) in heads for r in segs)
    assert min(min(e, rc(e)) for e in edges_by_force([ring + ring[:k]], k)) in heads


def test_masks_and_classes(spark):
    left, right, shared = dna(31, 100), dna(32, 100), dna(33, 60)
    index = classify.two_genome_index(*(kmerset.build(table(spark, x, shared), 15) for x in (left, right)), 15)
    reads = table(spark, left[10:60], rc(right[5:70]), shared, left[:40] + "N" + right[:40], dna(34, 50), "")
    got = {r.read_id: r.cls for r in classify.classified(classify.read_masks(reads, index, 15)).collect()}
    assert got == {0: "left", 1: "right", 2: "both", 3: "ambiguous", 4: "neither", 5: "neither"}
    summary = {r.cls: r.n for r in classify.class_summary(classify.read_masks(reads, index, 15)).collect()}
    assert summary == {"left": 1, "right": 1, "both": 1, "ambiguous": 1, "neither": 2}
    refs = spark.createDataFrame([(0, left), (64, right), (200, shared)], "ref int, seq string")
    got = {r.read_id: ([(m.word, m.mask) for m in r.masks], r.refs, r.matched) for r in classify.select_by_references(reads, classify.reference_masks(refs, 15), 15, 2).collect()}
    assert got == {0: ([(0, 1)], 1, False), 1: ([(1, 1)], 1, False), 2: ([(3, 256)], 1, False), 3: ([(0, 1), (1, 1)], 2, True), 4: ([], 0, False), 5: ([], 0, False)}


@pytest.mark.parametrize("most", [None, -1])
def test_hits_by_sent_sets_and_by_filter(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(classify, "BROADCAST_BYTES", most)
    a = dna(97, 60)
    index = kmerset.build(table(spark, a), 9)
    reads = [a[5:30], rc(a[20:40]), dna(98, 40), "", "ACGT"]
    held = {r.kmer for r in index.collect()}
    want = sorted((i, c) for i, s in enumerate(reads) for w in windows(s, 9) if (c := min(w, rc(w))) in held)
    assert sorted(map(tuple, classify.hits(table(spark, *reads), index, 9).collect())) == want
    more = classify.hits(table(spark, *reads), index.withColumn("one", F.lit(1)), 9)
    assert more.columns.count("kmer") == 1 and sorted((r.read_id, r.kmer) for r in more.where("one = 1").collect()) == want


def test_lowest_common_ancestors(spark):
    paths = spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, [0, 2]), (3, [0, 1, 3]), (4, [0, 1, 4])], "node int, path array<int>")
    a, b, c = dna(41, 50), dna(42, 50), dna(43, 50)
    refs = spark.createDataFrame([(3, a), (4, a), (3, b), (2, b), (3, c)], "node int, seq string")
    lca = classify.annotate_lca(refs, paths, 21)
    by = {r.kmer: r.node for r in lca.collect()}
    assert {by[min(w, rc(w))] for w in windows(a, 21)} == {1} and {by[min(w, rc(w))] for w in windows(b, 21)} == {0} and {by[min(w, rc(w))] for w in windows(c, 21)} == {3}
    assert {r.node: (r.own, r.total) for r in classify.subtree_totals(lca, paths).collect()} == {0: (30, 90), 1: (30, 60), 3: (30, 30)}
    got = {r.read_id: r.node for r in classify.classify_taxa(table(spark, a, b + "N" + c, dna(44, 40)), lca, paths, 21).collect()}
    assert got == {0: 1, 1: 3}


def test_similarity(spark):
    samples = {"x": dna(51, 200), "y": dna(51, 200)[:120] + dna(52, 80), "z": dna(53, 200)}
    df = spark.createDataFrame(list(samples.items()), "sample string, seq string")
    sets = {n: {min(w, rc(w)) for w in windows(s, 9)} for n, s in samples.items()}
    got = {(r.i, r.j): r.sim for r in spectrum.jaccard(spectrum.incidence(df, 9)).collect()}
    assert got == {(i, j): pytest.approx(len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in sets for j in sets if i < j}
    assert spectrum.single(df, 3).count() == 32


def test_fastq_shapes():
    good = ["@a", "ACGT", "+", "!!!!", "@b", "AC", "GT", "+b", "@@", "@!", "@c", "", "+", ""]
    assert list(R.parse_fastq(good)) == [("a", "ACGT", "", "!!!!"), ("b", "ACGT", "b", "@@@!"), ("c", "", "", "")]
    for bad in (["a", "ACGT"], ["@a", "ACGT"], ["@a", "ACGT", "+", "!!"], ["@a", "AC", "+", "!!!"], ["@a", "AC", "+x", "!!"]):
        with pytest.raises(ValueError):
            list(R.parse_fastq(bad))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nACG\n>two\n\nTT\n")
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\n@@@@\n@r2\nAC\n+\n!!\n")
    (tmp_path / "a.txt").write_text("ACGT\n\nTT\n")
    fa = R.read_fasta(spark, str(tmp_path / "a.fa"))
    assert [(r.label, r.seq) for r in fa.collect()] == [("one x", "ACGTACG"), ("two", "TT")]
    fq, ln = R.read_fastq(spark, str(tmp_path / "a.fq")), R.read_lines(spark, str(tmp_path / "a.txt"))
    assert [(r.label, r.seq, r.qual) for r in fq.collect()] == [("r1", "ACGT", "@@@@"), ("r2", "AC", "!!")]
    assert [(r.seq, r.qual) for r in ln.collect()] == [("ACGT", "BBBB"), ("", ""), ("TT", "BB")]
    assert R.union(fa, fq, ln).count() == 7
    assert [(r.pair_id, r.r1.seq, r.r2.seq) for r in R.pairs(fq, ln).orderBy("pair_id").collect()] == [(0, "ACGT", "ACGT"), (1, "AC", "")]
    assert [r.value for r in R.same_format_text(fq).collect()] == ["@r1\nACGT\n+\n@@@@", "@r2\nAC\n+\n!!"]
    long = spark.createDataFrame([("c", "A" * 120 + "C")], "label string, seq string")
    assert R.fasta_text(long, "label").first().value == ">c\n" + "A" * 60 + "\n" + "A" * 60 + "\nC"
    R.save(kmerset.build(fa, 3), str(tmp_path / "set"), "set", 3)
    back, k = R.load(spark, str(tmp_path / "set"), "set")
    assert k == 3 and back.count() == kmerset.build(fa, 3).count()
    with pytest.raises(ValueError):
        R.load(spark, str(tmp_path / "set"), "graph")


def test_fixing_reads(spark):
    genome = dna(61, 120)
    wrong = genome[:50] + rc(genome[50]) + genome[51:]
    g = graph.build(table(spark, genome), 13)
    got = {r.read_id: (r.seq, r.n_fixed) for r in correct.fix_reads(table(spark, wrong, genome, dna(62, 30)), g, 13).collect()}
    assert got == {0: (genome, 1), 1: (genome, 0), 2: (dna(62, 30).lower(), 0)}


def test_fixing_reads_with_many_errors(spark):
    genome = dna(63, 400)
    wrong = "".join(rc(x) if i in {3, 40, 60, 66, 130, 200, 290, 397} else x for i, x in enumerate(genome))
    g = graph.build(table(spark, genome), 13)
    assert {r.read_id: (r.seq, r.n_fixed) for r in correct.fix_reads(table(spark, wrong, genome[:9]), g, 13).collect()} == {0: (genome, 8), 1: (genome[:9].lower(), 0)}


def test_threading_and_scaffolds(spark):
    a, b, c, d, mid = (dna(70 + i, 120) for i in range(5))
    mid = mid[:30]
    genomes, k = [a + mid + b, c + mid + d], 21
    g = graph.build(table(spark, *genomes), k)
    got = supergraph.thread_reads(g, table(spark, *genomes), k, coverage=1.0, least=1).collect()
    seqs = {r.seq for r in got}
    assert all(x in seqs or rc(x) in seqs for x in genomes)
    joins = spark.createDataFrame([("p", "q"), ("q", "r"), ("x", "y"), ("y", "x")], "lhs string, rhs string")
    assert {(r.path, r.root, r.rank) for r in supergraph.chain(joins).collect()} == {("p", "p", 0), ("q", "p", 1), ("r", "p", 2), ("x", "x", 0), ("y", "x", 1)}
    paths = spark.createDataFrame([("p", "ACGT"), ("q", "GGGG"), ("r", "TTTT")], "path string, seq string")
    links = spark.createDataFrame([("p", "q", 20, 3.0), ("p", "r", 15, 1.0), ("q", "r", 2, 1.0)], "lhs string, rhs string, n long, gap double")
    assert sorted(r.seq for r in scaffold.scaffold(paths, links, 3).collect()) == ["ACGTNNNGGGG", "TTTT"]


def test_walks_that_begin_with_a_short_step(spark):
    rows = [("l", "o", "A", 5), ("r", "G", "z", 5), ("q", "A", "X", 10), ("s", "X", "G", 50)] + [(f"p{i:02}", "A", "X", 50 + i) for i in range(12)]
    paths = spark.createDataFrame(rows, "path string, start string, end string, length long")
    links = spark.createDataFrame([("l", "r", 60.0)], "lhs string, rhs string, gap double")
    assert [(r.via, r.found) for r in supergraph.connecting(links, paths).collect()] == [(["q", "s"], 60)]


def test_mixture_fit():
    rnd = np.random.default_rng(17)
    draws = np.concatenate([rnd.poisson(1.0, 60_000), np.round(rnd.normal(40, 6, 40_000)).astype(int)])
    hist = [(int(m), int(n)) for m, n in zip(*np.unique(draws[draws > 0], return_counts=True), strict=True)]
    theta = stats.fit_mixture(hist)
    assert theta[2] == pytest.approx(40, abs=1) and theta[3] == pytest.approx(6, abs=1)
    assert 3 <= stats.infer_cutoff(hist) <= 20
    assert stats.fit_mixture(hist[:20]) is None
    assert stats.log_binomial_tail(10, 3, 0.5) == pytest.approx(math.log(sum(math.comb(10, i) for i in range(3, 11)) / 1024))


def test_streamed_counts(spark, tmp_path):
    from strandlake.streaming.counts import count_stream

    seqs = [dna(80 + i, 60) for i in range(4)]
    for i, s in enumerate(seqs):
        table(spark, s).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = {r.kmer: r.n for r in count_stream(stream, 9, str(tmp_path / "state")).table.collect()}
    assert got == collections.Counter(min(w, rc(w)) for s in seqs for w in windows(s, 9))


def test_streamed_counts_go_on_after_a_restart(spark, tmp_path):
    from strandlake.streaming.counts import classify_batches, count_stream, windowed_counts

    seqs, at = [dna(90 + i, 60) for i in range(5)], str(tmp_path / "in")
    want = lambda n: collections.Counter(min(w, rc(w)) for s in seqs[:n] for w in windows(s, 9))
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet
    for n, s in enumerate(seqs, 1):
        spark.createDataFrame([(n, s)], "read_id long, seq string").coalesce(1).write.mode("append").parquet(at)
        if n in (2, 3, 5):  # each time a new query on the same checkpoint
            assert {r.kmer: r.n for r in count_stream(stream(at), 9, str(tmp_path / "state"), every=2).table.collect()} == want(n)
    index, seen = classify.two_genome_index(kmerset.build(table(spark, seqs[0]), 15), kmerset.build(table(spark, seqs[1]), 15), 15), {}
    index = spark.createDataFrame(index.collect(), index.schema)
    classify_batches(stream(at), index, 15, lambda df, n: seen.update({r.read_id: r["mask"] for r in df.collect()}), str(tmp_path / "classes")).awaitTermination()
    assert seen == {1: 4, 2: 2, 3: 0, 4: 0, 5: 0}
    events = spark.createDataFrame([("2024-01-01 00:05:00", "a"), ("2024-01-01 03:00:00", "a"), ("2024-01-01 00:06:00", "late")], "ts string, key string").selectExpr("cast(ts as timestamp) as ts", "key")
    for i, row in enumerate(events.collect()):
        spark.createDataFrame([row], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        held = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "ts", "key")
        held.writeStream.format("parquet").option("path", str(tmp_path / "windows")).option("checkpointLocation", str(tmp_path / "w")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r.key for r in spark.read.parquet(str(tmp_path / "windows")).collect()] == ["a"]


def test_wrapped_and_long_fastq(spark, tmp_path):
    rows = [(f"r{i}", dna(300 + i, 20 + i % 7)) for i in range(200)]
    (tmp_path / "plain.fq").write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in rows))
    (tmp_path / "wrapped.fq").write_text("".join(f"@{n}\r\n{s[:9]}\r\n{s[9:]}\r\n+{n}\r\n{'+' * 9}\r\n{'@' * (len(s) - 9)}\r\n" for n, s in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # many splits a file
    try:
        both = R.read_fastq(spark, str(tmp_path / "plain.fq"), str(tmp_path / "wrapped.fq")).orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("plain", "wrapped"):
        assert [(r.label, r.seq) for r in both if r.file.endswith(f"{name}.fq")] == rows
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\n!!!\n")
    with pytest.raises(Exception, match="4 bases, 3 qualities"):
        R.read_fastq(spark, str(tmp_path / "bad.fq"))
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(ValueError, match="before the first record"):
        R.read_fasta(spark, str(tmp_path / "bad.fa"))


def test_dumps_have_headers(spark):
    g = graph.build(table(spark, dna(5, 60)), 11)
    lines = R.graph_text(g, 11)
    assert [r.value for r in lines.limit(2).collect()] == ["#1", f"11 {g.count()} 0"]
    assert as_dict(R.parse_graph_text(lines)) == as_dict(g)
    with pytest.raises(ValueError, match="edges"):
        R.parse_graph_text(lines.where(f"not startswith(value, '{sorted(as_dict(g))[0]}')"))
    with pytest.raises(ValueError, match="no header"):
        R.parse_graph_text(R.graph_text(g))


def test_threading_by_pairs(spark):
    from strandlake.plans.assembly import assemble

    a, b, c, d = (dna(170 + i, 150) for i in range(4))
    mid, k, insert = dna(175, 40), 21, 120
    genomes = [a + mid + b, c + mid + d]
    rows = [(1000 * g + i, x[i : i + 35], rc(x[i + insert - 35 : i + insert])) for g, x in enumerate(genomes) for i in range(0, len(x) - insert + 1)]
    mates = spark.createDataFrame(rows, "pair_id long, s1 string, s2 string")
    edges = graph.build(table(spark, *genomes), k)
    placed = supergraph.placed_mates(mates, supergraph.edge_index(edges), k)
    size = supergraph.insert_size(placed, supergraph.superpaths(compact.segments(edges), k), k).first()
    assert size["mean"] == pytest.approx(insert) and size.deviation == 0
    got = {r.seq for r in supergraph.thread_pairs(edges, mates, k, insert, coverage=1.0, least=3).collect()}
    assert all(x in got or rc(x) in got for x in genomes)
    made = {r.seq for r in assemble(spark.createDataFrame([], "read_id long, seq string"), k, 0, 1, 50, 3, mates, insert, coverage=20.0).collect()}
    assert {len(x) for x in made} <= {340, 338, 339} and all(any(x in y or rc(x) in y for y in genomes) for x in made) and len(made) == 2


def test_entry_works_without_the_corpus_operators():
    import ast
    import pathlib

    top = pathlib.Path(__file__).parent.parent
    for path in (top / "strandlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "strandlake.llm" not in path.read_text(), path
    assert {f.name for f in ast.parse((top / "__spark_entry__.py").read_text()).body if isinstance(f, ast.FunctionDef)} >= {"entry", "queries", "oracle_sql"}


def test_logarithms_of_tails_and_differences(spark):
    cases = [(n, m) for n in (1, 5, 40, 700) for m in (0, 1, 3, n // 2, n, n + 1)]
    df = spark.createDataFrame(cases, "n int, m int")
    for p in (0.01, 0.6):
        for r in df.select("n", "m", S.log_binomial_at_least("n", "m", p).alias("x")).collect():
            assert r.x == pytest.approx(stats.log_binomial_tail(r.n, r.m, p), abs=1e-9)
    row = spark.createDataFrame([(3.0, 1.0)], "a double, b double").select(S.log_sub(F.col("a"), F.col("b")), S.log_sub(F.col("a"), F.col("a")), S.log_sub(F.col("b"), F.col("a"))).first()
    assert row[0] == pytest.approx(math.log(math.exp(3) - math.exp(1))) and row[1] == -math.inf and row[2] is None


def test_families_keep_genes_near_the_best(spark):
    lengths = {"a": 50, "b": 50, "c": 50, "d": 5000}
    found = {(1, "a"): 50, (1, "b"): 49, (1, "c"): 40, (2, "c"): 10, (3, "d"): 1}
    hits = spark.createDataFrame([(r, g, n) for (r, g), n in found.items()], "read_id long, gene string, n long")
    held = {(r.read_id, r.gene): r.score for r in spectrum.families(hits, spark.createDataFrame(list(lengths.items()), "gene string, length long")).collect()}
    score = {k: -stats.log_binomial_tail(lengths[k[1]], lengths[k[1]] - n, 0.01) for k, n in found.items()}
    best = {r: min(s for (q, _), s in score.items() if q == r) for r in (1, 2, 3)}
    expected = {k: s for k, s in score.items() if s <= 100 and s <= best[k[0]] + 5}
    assert held == pytest.approx(expected, abs=1e-9) and (1, "c") not in held and (3, "d") not in held and (1, "b") in held


def test_best_prefix_aligns_the_whole_path(spark):
    rows = [("ACGTACGTTT", "ACGTACG", 7), ("ACGTTACGAA", "ACGTACG", 8), ("ACGACGAA", "ACGTACG", 6), ("TTTT", "ACGA", 0), ("acgt", "ACGT", 4), (None, "A", None), ("", "A", 0), ("ACG", "", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, n long")
    for r in df.withColumn("x", correct.match_length("a", "b")).collect():
        assert r.x == r.n, r


def test_scaffolds_join_overlapping_ends(spark):
    whole = dna(90, 300)
    other = dna(91, 120)
    rows = [("p", whole[:160]), ("q", whole[130:]), ("r", other)]
    paths = spark.createDataFrame(rows, "path string, seq string")
    links = spark.createDataFrame([("p", "q", 20, -25.0), ("q", "r", 20, -5.0)], "lhs string, rhs string, n long, gap double")
    assert [(r.lhs, r.rhs, r.overlap) for r in supergraph.end_overlaps(paths, links).collect()] == [("p", "q", 30)]
    (made,) = scaffold.scaffold(paths, links, 10).collect()
    assert made.seq == whole + "N" + other and made.n_paths == 3


def test_prefixes_and_the_drawing_of_paths(spark):
    seqs = [dna(5, 60), dna(6, 60)]
    held = kmerset.build(table(spark, *seqs), 11)
    prefixes = spark.createDataFrame([("ACG",), ("ACG",), ("TTT",)], "prefix string")
    assert sorted(r.kmer for r in kmerset.with_prefix(held, prefixes, 3).collect()) == sorted(r.kmer for r in held.collect() if r.kmer[:3] in ("ACG", "TTT"))
    segs = compact.segments(graph.build(table(spark, *seqs), 11))
    heads = sorted((r.head, r.last) for r in segs.collect())
    lines = [r.value for r in R.superdot_text(segs, 11).collect()]
    nodes = sorted({x for h, last in heads for x in (h[:11], last[-11:])})
    drawn = '" fontcolor="black"color="black"];'
    expected = ["digraph {", *(f'\t{n} [shape="point", label="{drawn}' for n in nodes), *(f'\t{h[:11]} -> {last[-11:]} [label=" {i}{drawn}' for i, (h, last) in enumerate(heads)), "}"]
    assert lines == expected


def test_assembly_with_mates_gives_the_whole(spark):
    from strandlake.plans.assembly import assemble

    whole, k = dna(77, 260), 13
    reads = table(spark, *[whole[i : i + 60] for i in range(0, 201, 4)])
    mates = spark.createDataFrame([(i, whole[i : i + 30], rc(whole[i + 90 : i + 120])) for i in range(0, 140, 5)], "pair_id long, s1 string, s2 string")
    (made,) = assemble(reads, k, cutoff=1, tips=2, min_links=3, mates=mates, insert=120).collect()
    assert made.seq in (whole[:256], rc(whole[:256]))  # one read alone has the last four bases
