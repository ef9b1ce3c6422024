"""Corpus pipeline: quality, exact copies, near copies, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import curve_packing, merge_index, ngram_join, rule_ensemble
from strandlake.llm.common import stage, table
from strandlake.llm.vocabularies import WORD_BPE
from strandlake.sources.staging import free


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled rows among docs, doesn't reject.

    A null text counts as empty and has a score too. Rows without doc_id, repeated rows and rows without
    a label are scored like others. Without labels every score is the same. An empty table stays empty.
    """
    return rule_ensemble.keep_good(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id.

    Texts are equal after each run of white space became one space; null counts as empty. A null doc_id
    stays only if its group has no other; of rows repeated with doc_id and text one stays.
    """
    return merge_index.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link, the one with the smallest doc_id.

    Texts without words, null ones too, are linked with nothing and stay. Rows that share a doc_id stay or
    go together. An empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the remaining documents are packed into.

    Every row is a document, a null or empty text its end token alone. An empty table has no pieces.
    """
    return curve_packing.pack(docs, WORD_BPE())


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("packing", packing)]

#: Rules fitted to labels, links between near copies and tokens can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        before, docs = docs, step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
            free(before)  # nothing reads it any more
    return docs
