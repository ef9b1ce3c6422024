"""K-mer spectra, sample similarity and abundance."""

from __future__ import annotations

import math

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import packed
from strandlake.functions.seq import canonical, dna_of_text, kmers, log_binomial_at_least
from strandlake.sources.staging import free, staged


def universe(spark, k: int) -> DataFrame:
    """All canonical k-mers of a k up to 31, from the numbers below 4**k, two bits a base."""
    out = spark.range(4**k).select(F.col("id"))
    base = "substring('ACGT', cast(shiftright(id, {s}) & 3 as int) + 1, 1)"
    out = out.select(F.expr("concat(" + ", ".join(base.format(s=2 * (k - 1 - i)) for i in range(k)) + ")").alias("kmer"))
    return out.where(F.col("kmer") == canonical("kmer"))


def single(reads: DataFrame, k: int = 8, seq: str = "seq") -> DataFrame:
    """kmer, n over the whole universe of canonical k-mers."""
    counts = kmers(reads, k, seq).select(canonical("kmer").alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return universe(reads.sparkSession, k).join(counts, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def per_read(reads: DataFrame, k: int = 8, key: str = "read_id", seq: str = "seq") -> DataFrame:
    """key, kmer, n of each read."""
    return kmers(reads, k, seq, keep=(key,)).select(key, canonical("kmer").alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def incidence(reads: DataFrame, k: int, sample: str = "sample", seq: str = "seq", letters: np.ndarray = packed.CODES) -> DataFrame:
    """sample, kmer, each once."""
    if k <= 31:
        return packed.unpacked(packed.sample_sets(reads.withColumnRenamed(sample, "sample"), k, "sample", seq, letters), k)
    reads = reads if letters is packed.CODES else reads.withColumn(seq, dna_of_text(seq))
    return kmers(reads, k, seq, keep=(sample,)).select(F.col(sample).alias("sample"), canonical("kmer").alias("kmer")).distinct()


def within(reads: DataFrame, kmer_set: DataFrame, samples: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """sample, score: counts of the reads' k-mers in the set, summed over each reference sample that has the k-mer."""
    counts = kmers(reads, k, seq).select(canonical("kmer").alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).join(kmer_set, "kmer", "left_semi")
    return counts.join(samples, "kmer").groupBy("sample").agg(F.sum("n").alias("score"))


def _shared(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample, size), (i, j, common): pairs are counted by group of samples that share k-mers, not k-mer by k-mer.

    K-mers with the same set of samples are one row with a weight; sample sets are small next to k-mers.
    """
    samples = staged(samples, "samples")
    sizes = samples.groupBy("sample").agg(F.count("*").alias("size"))
    sets = samples.groupBy("kmer").agg(F.sort_array(F.collect_set("sample")).alias("s")).groupBy("s").agg(F.count("*").alias("w"))
    both = sets.select("w", "s", F.explode("s").alias("i")).select("w", "i", F.explode("s").alias("j")).where("i < j")
    return sizes, both.groupBy("i", "j").agg(F.sum("w").alias("common"))


def jaccard(samples: DataFrame) -> DataFrame:
    """i, j, sim of all pairs of samples i < j."""
    sizes, common = _shared(samples)
    a, b = sizes.select(F.col("sample").alias("i"), F.col("size").alias("ni")), sizes.select(F.col("sample").alias("j"), F.col("size").alias("nj"))
    held = a.join(b, F.col("i") < F.col("j")).join(common, ["i", "j"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return held.select("i", "j", (F.col("common") / (F.col("ni") + F.col("nj") - F.col("common"))).alias("sim"))


def containment(kmer_set: DataFrame, samples: DataFrame) -> DataFrame:
    """sample, containment: share of the sample's k-mers in the set."""
    held = samples.join(kmer_set.withColumn("hit", F.lit(1)), "kmer", "left")
    return held.groupBy("sample").agg((F.count("hit") / F.count("*")).alias("containment"))


def abundance(hits: DataFrame, lengths: DataFrame, rounds: int = 20) -> DataFrame:
    """gene, count, fpkm by expectation maximisation. hits: read_id, gene, n (shared k-mers); lengths: gene, length.

    A read is shared among the genes with its highest n in proportion to their current abundance; every
    round is a join and two aggregations, staged now and then.
    """
    best = hits.groupBy("read_id").agg(F.max("n").alias("n"))
    held = staged(hits.join(best, ["read_id", "n"]).select("read_id", "gene"), "em-hits")
    share = held.select("gene").distinct().withColumn("p", F.lit(1.0))
    for k in range(rounds):
        weights = held.join(share, "gene")
        total = weights.groupBy("read_id").agg(F.sum("p").alias("t"))
        share = weights.join(total, "read_id").groupBy("gene").agg(F.sum(F.col("p") / F.col("t")).alias("p"))
        if k % 5 == 4:
            share = staged(share, "em-share")
    reads = held.select("read_id").distinct().count()
    return share.join(lengths, "gene").select("gene", F.col("p").alias("count"), (F.col("p") * 1e9 / (F.col("length") * F.lit(max(1, reads)))).alias("fpkm"))


def families(hits: DataFrame, lengths: DataFrame, error: float = 0.01, within: float = 5.0, most: float = 100.0) -> DataFrame:
    """read_id, gene, score: the genes that explain a read about as well as its best one, in nats.

    A gene's score is -log P(X >= missing) for X binomial over its windows with the error rate, where missing
    counts the windows that the read lacks. Genes with more than ``most`` nats, or ``within`` more than the
    read's best, are left out. Scores are found once for each length and number missing.
    hits: read_id, gene, n (shared k-mers); lengths: gene, length (windows).
    """
    missing = F.greatest(F.lit(0), F.col("length") - F.col("n")).cast("long").alias("missing")
    held = staged(hits.join(lengths, "gene").select("read_id", "gene", F.col("length").cast("long").alias("length"), missing), "family-hits")
    scores = held.select("length", "missing").distinct().withColumn("score", 0.0 - log_binomial_at_least("length", "missing", error))
    scored = held.join(scores.where(F.col("score") <= most), ["length", "missing"])
    best = F.min("score").over(Window.partitionBy("read_id"))
    return scored.withColumn("best", best).where(F.col("score") <= F.col("best") + within).select("read_id", "gene", "score")


def mixture(scored: DataFrame, lengths: DataFrame, replicates: int = 16, tolerance: float = 1e-6, seed: int = 1) -> DataFrame:
    """gene, count, count_error, fpkm, fpkm_error by expectation maximisation over the likelihoods of reads, until nothing moves.

    A read is shared among its genes in proportion to their current abundance times exp(-score). Reads that
    have the same genes with the same scores are one class, so a round costs what the classes do. Errors are standard deviations
    over replicates in which every read counts as often as a Poisson variable of mean one drawn by its
    identifier says; all replicates run through the same rounds. The rounds end when no gene's count, in the sample or a replicate, moves by
    more than tolerance times the number of reads in five of them. scored: read_id, gene, score in nats (as families() gives them); lengths: gene, length.
    """
    names = [f"p{i}" for i in range(replicates + 1)]
    held = scored.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("gene", F.round("score", 9).alias("score")))).alias("genes"))
    # the inverse of the distribution function: from which uniform number on the variable is at least 1, 2, ...
    steps, term, cumulated = [], math.exp(-1), 0.0
    for i in range(1, 13):
        cumulated, term = cumulated + term, term / i
        steps.append(cumulated)
    uniform = [F.pmod(F.xxhash64("read_id", F.lit(seed), F.lit(i)), F.lit(2**40)) / float(2**40) for i in range(replicates)]
    drawn = [F.lit(1.0), *(sum(((u >= x).cast("double") for x in steps), F.lit(0.0)) for u in uniform)]
    classes = held.groupBy("genes").agg(*(F.sum(d).alias(n) for d, n in zip(drawn, names, strict=True)))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("class"), "genes", *names), "mixture-classes")
    weights = classes.select("class", *(F.col(n).alias(f"w_{n}") for n in names))
    parts = staged(classes.select("class", F.explode("genes").alias("g")).select("class", "g.gene", F.exp(-F.col("g.score")).alias("likelihood")), "mixture-parts")
    reads = float(weights.agg(F.sum("w_p0")).first()[0] or 0.0)
    share = staged(parts.select("gene").distinct().select("gene", *(F.lit(1.0).alias(n) for n in names)), "mixture")
    moved = math.inf
    while moved > tolerance * reads:
        before = share
        for _ in range(5):
            own = parts.join(share, "gene").select("class", "gene", *((F.col(n) * F.col("likelihood")).alias(n) for n in names))
            total = own.groupBy("class").agg(*(F.sum(n).alias(f"t_{n}") for n in names)).join(weights, "class")
            share = own.join(total, "class").groupBy("gene").agg(*(F.sum(F.when(F.col(f"t_{n}") > 0, F.col(n) / F.col(f"t_{n}") * F.col(f"w_{n}")).otherwise(0.0)).alias(n) for n in names))
        share = staged(share, "mixture")
        change = share.join(before.select("gene", *(F.col(n).alias(f"o_{n}") for n in names)), "gene").agg(F.max(F.greatest(*(F.abs(F.col(n) - F.col(f"o_{n}")) for n in names)) if replicates else F.abs(F.col("p0") - F.col("o_p0"))))
        moved = change.first()[0] or 0.0
        free(before)
    mean = sum((F.col(n) for n in names[1:]), F.lit(0.0)) / max(1, replicates)
    error = F.sqrt(sum(((F.col(n) - mean) ** 2 for n in names[1:]), F.lit(0.0)) / max(1, replicates - 1))
    scale = 1e9 / (F.col("length") * F.lit(max(1.0, reads)))
    out = share.join(lengths, "gene").select("gene", F.col("p0").alias("count"), error.alias("count_error"), (F.col("p0") * scale).alias("fpkm"), (error * scale).alias("fpkm_error"))
    free(classes, parts)
    return out
