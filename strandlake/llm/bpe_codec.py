"""Operator 5: BPE encoding and decoding of whole texts (segment trees, see word_bpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import word_bpe
from strandlake.llm.common import arrow_batches, table


def encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every whole text; a null text has no ids. Repeated rows stay repeated, other columns are left out."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(tokenizer)
        for b in batches:
            e = bpe.encode_arrow(b.column(1))
            ids = pa.ListArray.from_arrays(pa.array(e.bounds.astype(np.int32)), pa.array(e.ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    source = docs.select(key, text)
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of ids as encode() returns them; null ids give null, ids outside the vocabulary are passed over."""
    arrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(tokenizer)
        for b in batches:
            texts = [None if x is None else bpe.decode([i for i in x if i in bpe.tokens]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    source = encoded.select(key, "ids")
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text.

    A null text counts as empty; an empty text has no tokens and the digests of no bytes. Repeated
    rows and null identifiers stay as they are. Work is one pass without a shuffle; memory is
    bounded by an Arrow batch.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(tokenizer)
        for b in batches:
            e = bpe.encode_arrow(b.column(1))
            ids = e.ids.astype("<u4", copy=False)
            cuts = e.bounds.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(e.bounds), pa.int64()),
                    pa.array([hashlib.sha256(ids[a:z]).hexdigest() for a, z in zip(cuts, cuts[1:])], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decoded_bytes(e)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from strandlake.llm.vocabularies import WORD_BPE

    return digests(table(spark, sf_dir, "documents"), tokenizer or WORD_BPE())
