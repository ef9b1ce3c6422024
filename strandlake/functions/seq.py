"""Column functions over sequences, and the k-mer table function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows taken from one piece of a sequence: substring() walks a string from its start, so pieces are short.
CHUNK = 256


def reverse_complement(x: Column | str) -> Column:
    """The other strand, base by base from the end."""
    return F.reverse(F.translate(F.col(x) if isinstance(x, str) else x, "ACGT", "TGCA"))


def canonical(x: Column | str) -> Column:
    """The smaller of both strands in lexicographic order, which is also that of packed two-bit codes."""
    x = F.col(x) if isinstance(x, str) else x
    return F.least(x, reverse_complement(x))


def is_valid(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).rlike("^[ACGTacgt]+$")


def source_node(edge: Column | str) -> Column:
    """All bases of an edge but the last."""
    edge = F.col(edge) if isinstance(edge, str) else edge
    return F.substring(edge, F.lit(1), F.length(edge) - 1)


def target_node(edge: Column | str) -> Column:
    """All bases of an edge but the first."""
    edge = F.col(edge) if isinstance(edge, str) else edge
    return F.substring(edge, F.lit(2), F.length(edge) - 1)


def dna_of_text(text: Column | str) -> Column:
    """Letters a to z mapped to ACGT in turn; everything else is left out."""
    text = F.col(text) if isinstance(text, str) else text
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), letters, ("ACGT" * 7)[:26])


def kmers(reads: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = (), offsets: bool = False) -> DataFrame:
    """The columns kept and kmer (upper case) for each window of k consecutive valid bases; ``pos`` from 0 if asked for.

    Any character outside ACGT in either case breaks the window. Sequences shorter than k, empty and
    null ones give no rows. Long sequences are cut into overlapping chunks first.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    bases = F.upper(F.col(seq))
    if offsets:  # runs keep their place: other characters become one space each
        held = reads.select(*keep, F.regexp_replace(bases, "[^ACGT]", " ").alias("__run"))
    else:
        held = reads.select(*keep, F.explode(F.split(bases, "[^ACGT]+")).alias("__run"))
    held = held.where(F.length("__run") >= k)
    held = held.select(*keep, "__run", F.explode(F.expr(f"sequence(0, length(__run) - {k}, {CHUNK})")).alias("__at"))
    held = held.select(*keep, "__at", F.expr(f"substring(__run, __at + 1, {CHUNK + k - 1})").alias("__piece"))
    windows = F.expr(f"transform(sequence(1, length(__piece) - {k - 1}), i -> substring(__piece, i, {k}))")
    if not offsets:
        return held.select(*keep, F.explode(windows).alias("kmer"))
    out = held.select(*keep, "__at", F.posexplode(windows).alias("__i", "kmer")).where(~F.contains("kmer", F.lit(" ")))
    return out.select(*keep, (F.col("__at") + F.col("__i")).alias("pos"), "kmer")


def base_counts(seq: Column | str) -> list[Column]:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return [F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in "ACGT"]


def entropy0(seq: Column | str) -> Column:
    """Base-2 entropy of the base composition; 0 for an empty sequence."""
    counts = base_counts(seq)
    total = sum(counts[1:], counts[0])
    bits = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return F.when(total > 0, sum(bits[1:], bits[0])).otherwise(F.lit(0.0))


def entropy1(seq: str) -> Column:
    """Base-2 entropy of the dinucleotides, overlapping; 0 below two bases. Letters outside ACGT count as one more base."""
    x = F.regexp_replace(F.col(seq), "[^ACGT]", "N")
    letters = "ACGTN"
    pair = {(a, b): (F.length(x) - F.length(F.replace(x, F.lit(a + b), F.lit("")))) / 2 for a in letters for b in letters if a != b}
    for a in letters:  # of the places of a base, those behind another base or at the start begin a run
        runs = sum((pair[b, a] for b in letters if b != a), F.startswith(x, F.lit(a)).cast("int"))
        pair[a, a] = F.length(x) - F.length(F.replace(x, F.lit(a), F.lit(""))) - runs
    total = F.length(x) - 1
    bits = [F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(F.lit(0.0)) for n in pair.values()]
    return F.when(total > 0, sum(bits[1:], bits[0])).otherwise(F.lit(0.0))


def period2_share(seq: str) -> Column:
    """Share of bases equal to the one two places before."""
    return F.expr(f"case when length({seq}) < 3 then 0D else size(filter(sequence(3, length({seq})), i -> substring({seq}, i, 1) = substring({seq}, i - 2, 1))) / (length({seq}) - 2) end")


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sub(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)) without overflow; null where b is larger."""
    return F.when(a == b, F.lit(float("-inf"))).when(a > b, a + F.log1p(-F.exp(b - a)))


def log_binomial_at_least(n: str, m: str, p: float) -> Column:
    """log P(X >= m) for X binomial (n, p) with 0 < p < 1: the terms from the m-th on are added as logarithms, n steps in all."""
    first = f"(aggregate(sequence(1, {m}), {m} * ln({p}D) + ({n} - {m}) * ln({1 - p}D), (s, j) -> s + ln(({n} - {m} + j) / j)))"
    term = f"x.t + ln(({n} - i) / (i + 1)) + ln({p / (1 - p)}D)"
    added = f"greatest(x.s, {term}) + log1p(exp(-abs(x.s - ({term}))))"
    tail = f"aggregate(sequence({m}, {n} - 1), named_struct('t', {first}, 's', {first}), (x, i) -> named_struct('t', {term}, 's', {added}), x -> x.s)"
    return F.expr(f"case when {m} <= 0 then 0D when {m} > {n} then double('-Infinity') when {m} = {n} then {n} * ln({p}D) else least(0D, {tail}) end")


def uniqueness(size: Column, mean: Column, rho: Column, k: int) -> Column:
    """The A-statistic test of a path of ``size`` edges with mean coverage ``mean`` where ``rho`` is expected."""
    score = F.lit(0.6931471805599453) / 2 + size / (2 * rho) * (rho * rho - mean * mean / 2)
    return (size + k >= 50) & (score >= 5)
