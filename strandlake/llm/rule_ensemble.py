"""Operator 4: quality classifier as a sparse rule ensemble.

Shallow boosted trees are grown over statistics of labelled texts; every path from a root is a
conjunctive rule. A logistic regression with an L1 penalty gives most rules weight zero; the rest are
compiled into Spark column expressions, so scoring is one pass of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import SPACES, id_bucket, table, text_or_empty

#: Labelled rows at most that the rules are fitted on, taken in the order of a hash of doc_id.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, PENALTY, ROUNDS = 40, 3, 32, 0.3, 2e-3, 400
#: predicted is 1 from this score on (the query's contract).
CUT = 0.3

#: The statistics, by name, over the columns t (text), words, lines.
STATISTICS = {
    "chars": "cast(length(t) as double)",
    "words": "cast(size(words) as double)",
    "word_length": "length(t) / greatest(size(words), 1)",
    "longest_word": "cast(coalesce(array_max(transform(words, w -> length(w))), 0) as double)",
    "distinct_words": "size(array_distinct(words)) / greatest(size(words), 1)",
    "repeated_words": "size(filter(words, (w, i) -> i > 0 and w = words[i - 1])) / greatest(size(words), 1)",
    "short_words": "size(filter(words, w -> length(w) <= 2)) / greatest(size(words), 1)",
    "lines": "cast(size(lines) as double)",
    "distinct_lines": "size(array_distinct(lines)) / greatest(size(lines), 1)",
    "line_length": "length(t) / greatest(size(lines), 1)",
    "upper": "length(regexp_replace(t, '[^A-Z]+', '')) / greatest(length(t), 1)",
    "symbols": "length(regexp_replace(t, '[\\\\p{L}\\\\p{N}\\\\s.,]+', '')) / greatest(length(t), 1)",
    "digits": "length(regexp_replace(t, '[^0-9]+', '')) / greatest(length(t), 1)",
    "stops": "(length(t) - length(replace(t, '.', ''))) / greatest(length(t), 1)",
    "commas": "(length(t) - length(replace(t, ',', ''))) / greatest(length(t), 1)",
    "bars": "(length(t) - length(replace(t, '|', ''))) / greatest(length(t), 1)",
    "marks": "(length(t) - length(replace(t, '!', ''))) / greatest(length(t), 1)",
}
NAMES = list(STATISTICS)


def with_statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns kept and one double column, prefixed q_, for each statistic of the whole text; null counts as empty."""
    held = docs.select(*keep, text_or_empty(text).alias("t"))
    held = held.select(*keep, "t", F.expr(f"filter(split(t, '{SPACES.replace(chr(92), chr(92) * 2)}'), w -> w <> '')").alias("words"), F.expr("split(t, '\\n')").alias("lines"))
    return held.select(*keep, *(F.expr(f"cast({e} as double)").alias(f"q_{n}") for n, e in STATISTICS.items()))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, cut in self.terms:
            column = x[:, NAMES.index(name)]
            out &= column > cut if above else column <= cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.terms:
            out = out & (F.col(f"q_{name}") > F.lit(cut) if above else F.col(f"q_{name}") <= F.lit(cut))
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        z = F.lit(float(self.bias))
        for rule, w in self.weights:
            z = z + F.when(rule.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The rules of boosted trees on logistic loss, over quantile bins of each statistic."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, found = np.zeros(len(y)), {}

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = gradient[rows], hessian[rows]
        best, base = (1e-6, None), g.sum() ** 2 / (h.sum() + 1)
        for j, c in enumerate(cuts if left else []):
            gs = np.cumsum(np.bincount(bins[rows, j], weights=g, minlength=len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], weights=h, minlength=len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(bins[rows, j], minlength=len(c) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
            gain[(n < 5) | (len(rows) - n < 5)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (j, int(gain.argmax())))
        if best[1] is None:
            margin[rows] += RATE * g.sum() / (h.sum() + 1)
            return
        j, b = best[1]
        low = bins[rows, j] <= b
        for above, some in ((False, rows[low]), (True, rows[~low])):
            path = (*terms, (NAMES[j], above, float(cuts[j][b])))
            found.setdefault(Rule(path), None)
            split(some, path, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        split(np.arange(len(y)), (), depth)
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Bias and L1-penalised logistic weights by accelerated proximal gradient steps."""
    a = np.concatenate([np.ones((len(r), 1)), r], axis=1)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(np.linalg.norm(a @ v) ** 2)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        ahead = z + step * (a.T @ (y - 1 / (1 + np.exp(-np.clip(a @ z, -40, 40))))) / len(y)
        ahead[1:] = np.sign(ahead[1:]) * np.maximum(np.abs(ahead[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = ahead + (before - 1) / t * (ahead - w), ahead
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    """Fits the rules on at most max_rows labelled rows outside the held-out fold.

    Rows without a label, or of documents that are absent, are passed over; repeated labels of one
    document are averaged, and of rows that share a doc_id the least text counts, so at most max_rows rows
    come to the driver. With one label only, or none, or labelled texts that no statistic tells apart (or
    fewer than ten), the score is the smoothed share of label 1.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_bucket("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    labelled = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")  # the sample has max_rows rows at most
    held = with_statistics(labelled.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "y")
    data = held.toPandas()  # a row a doc_id of the sample
    y = data["y"].to_numpy(dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    without_rules = RuleModel(float(np.log(share / (1 - share))), ())
    if len(set(y.tolist())) < 2:
        return without_rules
    x = data[[f"q_{n}" for n in NAMES]].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the order in which tasks finish is of no matter
    x, y = x[order], y[order]
    rules = grow(x, y)
    if not rules:
        return without_rules
    bias, weights = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y)
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def classify(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Per row: doc_id, held_out, score in 0 .. 1, predicted. Null texts count as empty and have a score too; repeated rows stay."""
    held = with_statistics(docs, "doc_id")
    scored = held.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all columns.

    The row number keeps the filter above the statistics: pushed below, it would compute each of them
    again in every rule that names it.
    """
    held = with_statistics(docs.select(F.struct("*").alias("__row"), "text"), "__row").withColumn("__at", F.monotonically_increasing_id())
    return held.where((model.score() >= CUT) & (F.col("__at") >= 0)).select("__row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
