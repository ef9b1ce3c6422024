"""Operator 9: token counts by offset mapping.

A document is encoded whole, once; the character spans of its tokens are joined with the intervals of
its sections by binary search, and a token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_batches, table

#: first / last: the section of the token's first or last character; majority: the one with most of its
#: characters, the earlier of equals; split: a share to each by characters.
RULES = ("first", "last", "majority", "split")
#: Pre-tokenisation pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """(the encoding of a file of base64 tokens and ranks, bytes of each token)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, ids: list[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one behind the last of each token; a character of several bytes may lie in several tokens."""
    ends = np.cumsum(sizes[ids])
    if len(text) == (ends[-1] if len(ends) else 0):
        return ends - sizes[ids], ends
    raw = np.frombuffer(text.encode(errors="replace"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[ends - sizes[ids]], char[ends - 1] + 1


def allocate(first: np.ndarray, behind: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; sections are the gapless intervals that end at cuts."""
    a = np.searchsorted(cuts, first, side="right")
    z = np.searchsorted(cuts, behind - 1, side="right")
    n = len(cuts)
    crossing = np.flatnonzero(a < z)
    if rule == "first":
        home = a
    elif rule == "last":
        home = z
    elif rule == "majority":
        home = a.copy()
        for t in crossing.tolist():
            sections = np.arange(a[t], z[t] + 1)
            begins = np.where(sections > 0, cuts[sections - 1], 0)
            home[t] = sections[int((np.minimum(cuts[sections], behind[t]) - np.maximum(begins, first[t])).argmax())]
    else:
        counts = np.bincount(a[a == z], minlength=n).astype(np.float64)
        for t in crossing.tolist():
            sections = np.arange(a[t], z[t] + 1)
            begins = np.where(sections > 0, cuts[sections - 1], 0)
            counts[sections] += (np.minimum(cuts[sections], behind[t]) - np.maximum(begins, first[t])) / (behind[t] - first[t])
        return counts, np.bincount(a[crossing], minlength=n)
    return np.bincount(home, minlength=n).astype(np.float64), np.bincount(home[crossing], minlength=n)


def line_ends(text: str) -> np.ndarray:
    """The sections of a text by lines: each with its line feed."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return ends[:-1] if len(ends) > 1 and ends[-1] == ends[-2] else ends


def section_counts(docs: DataFrame, tokenizer: str, rule: str = "majority", ends: str | None = None) -> DataFrame:
    """Per section: doc_id, section (from 0), start, end (characters), n_tokens, n_crossing.

    docs: doc_id, text and, if ends names it, array<int> of the ascending places where sections end;
    what lies behind the last is one more section. Without it, sections are lines. The n_tokens of a
    document add up to its number of tokens under every rule. Null and empty texts are one section
    without tokens; repeated rows stay. One pass without a shuffle; memory is bounded by an Arrow batch.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(tokenizer)
        for b in batches:
            own, cuts_of, tokens, crossings = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                text = text or ""
                first, behind = token_spans(text, encoding.encode_ordinary(text), sizes)
                if ends is None:
                    cuts = line_ends(text)
                else:
                    given = sorted(min(max(0, e), len(text)) for e in b.column(2)[i].as_py() or [] if e is not None)
                    cuts = np.array(given + [len(text)] * (not given or given[-1] < len(text)), dtype=np.int64)
                n, crossing = allocate(first, behind, cuts, rule)
                own.append(np.full(len(cuts), i))
                cuts_of.append(cuts)
                tokens.append(n)
                crossings.append(crossing)
            row, end = np.concatenate(own or [np.zeros(0, int)]), np.concatenate(cuts_of or [np.zeros(0, int)])
            section = np.concatenate([np.arange(len(c)) for c in cuts_of] or [np.zeros(0, int)])
            start = np.where(section > 0, np.roll(end, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(section, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(np.concatenate(tokens or [np.zeros(0)])), pa.array(np.concatenate(crossings or [np.zeros(0, int)]), pa.int64())],
                ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(ends).cast("array<int>")] if ends else [])]
    counted = docs.select(*columns).mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")
    return counted if rule == "split" else counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from strandlake.llm.vocabularies import BYTE_BPE

    return section_counts(table(spark, sf_dir, "documents"), tokenizer or BYTE_BPE())
