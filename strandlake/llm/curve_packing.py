"""Operator 7: packing along a space-filling curve.

Every document's token identifiers are hashed to a vector, projected to a few dimensions and
placed on a grid; documents are range-sorted by the Hilbert key of their cell, so neighbours on
the curve are alike. Their token streams, one after the other along the curve, are cut into
sequences of fixed length: only the very last sequence can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import word_bpe
from strandlake.llm.common import arrow_batches, stage, table

#: Fixed values of the query's contract.
SEQUENCE, END_ID = 4096, 2
DIMENSIONS, BITS, BUCKETS = 5, 12, 4096


def projection(vocabulary: int, dimensions: int = DIMENSIONS, buckets: int = BUCKETS) -> np.ndarray:
    """Row i: where one occurrence of token i moves the projected vector. Tokens share buckets as a hashed vector has them."""
    signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(buckets, dimensions))
    ids = np.arange(vocabulary, dtype=np.uint64)
    return signs[((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets]


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of cells, whose coordinates have so many bits (rows x dimensions <= 62 bits in all).

    Gray-code form of the curve: from the highest bit down, the coordinates are reflected and
    exchanged so that each sub-cube is walked in the orientation of its place on the curve.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def grid_cells(ids: np.ndarray, bounds: np.ndarray, moves: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The cell of each document: its mean projected vector, squashed to the grid. Without tokens: the middle."""
    lengths = np.diff(bounds)
    sums = np.zeros((len(lengths), moves.shape[1]), dtype=np.float64)
    first = 0
    while first < len(lengths):  # so many tokens at once
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 2**20, side="right")) - 1)
        some = np.flatnonzero(lengths[first:last])
        if len(some):
            steps = moves[ids[bounds[first] : bounds[last]]]
            sums[first + some] = np.add.reduceat(steps, bounds[first:last][some] - bounds[first], axis=0)
        first = last
    mean = sums / np.maximum(1, np.sqrt(lengths))[:, None] / 4
    return np.clip((np.tanh(mean) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, curve key, number of tokens with the end, and the compressed ids of every row."""
    arrow_batches(docs.sparkSession, "2m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(tokenizer)
        moves = projection(bpe.size)
        kind = "<u2" if max(bpe.size, end_id) < 2**16 else "<u4"
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            e = bpe.encode_arrow(b.column(1))
            narrow, cuts = e.ids.astype(kind), e.bounds.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(hilbert_key(grid_cells(e.ids, e.bounds, moves)), pa.int64()),
                    pa.array(np.diff(e.bounds) + 1, pa.int64()),
                    pa.array([squeeze(narrow[a:z].tobytes()) for a, z in zip(cuts, cuts[1:])], pa.binary()),
                ],
                ["doc_id", "curve", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, curve long, doc_tokens long, ids binary")


def running_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of tokens before each row in its partition."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_numpy()
        ends = before + np.cumsum(n)
        before = int(ends[-1]) if len(n) else before
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part), pa.int32()), b.column(1), pa.array(ends - n, pa.int64())], ["rid", "part", "doc_tokens", "before"])


def positions(tokens: DataFrame) -> DataFrame:
    """rid and the number of tokens ahead of it in the order (curve, doc_id, rid).

    Range partitions are summed on their own; what is ahead of a partition is a sum over one row a partition.
    """
    ordered = (
        tokens.select("curve", "doc_id", "rid", "doc_tokens")
        .repartitionByRange("curve", "doc_id", "rid")
        .sortWithinPartitions("curve", "doc_id", "rid")
        .select("rid", "doc_tokens")
        .mapInArrow(running_starts, "rid long, part int, doc_tokens long, before long")
    )
    ordered = stage(ordered, "op7-order")
    totals = ordered.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    ahead = totals.select("part", F.expr("sum(n) over (order by part rows between unbounded preceding and 1 preceding)").alias("ahead"))
    return ordered.join(F.broadcast(ahead), "part").select("rid", (F.col("before") + F.coalesce("ahead", F.lit(0))).alias("position"))


def cut(placed: DataFrame, length: int, end_id: int, narrow: bool) -> DataFrame:
    """One row a piece: no piece crosses the end of a sequence."""
    kind = "<u2" if narrow else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ids_col, n_col, at_col = b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
            first_seq = at_col // length
            pieces = (at_col + n_col - 1) // length - first_seq + 1
            row = np.repeat(np.arange(len(n_col)), pieces)
            sequence = first_seq[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(at_col[row], sequence * length)
            size = np.minimum(at_col[row] + n_col[row], (sequence + 1) * length) - begin
            start = begin - at_col[row]
            sums, last, raw = [], -1, b""
            for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if r != last:
                    ids = np.append(np.frombuffer(expand(ids_col[r].as_py()), dtype=kind).astype("<u4"), np.uint32(end_id))
                    raw, last = ids.astype("<u4").tobytes(), r
                sums.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, size, sums, n_col[row], sequence, begin - sequence * length))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.select("doc_id", "ids", "doc_tokens", "position").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents in sequences of ``length`` tokens along the curve.

    Every row is a document of its own, repeated rows and null identifiers too (nulls come first among
    equal keys); a null or empty text is its end token alone. Equal keys are ordered by doc_id. An empty
    table has no pieces. Documents with one key, however many, are split over range partitions by doc_id.
    """
    arrow_batches(docs.sparkSession, "2m")
    tokens = stage(tokenize(docs, tokenizer, end_id).withColumn("rid", F.monotonically_increasing_id()), "op7-ids", "none")
    placed = tokens.join(positions(tokens), "rid")
    return cut(placed, length, end_id, max(word_bpe.load(tokenizer).size, end_id) < 2**16)


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from strandlake.llm.vocabularies import WORD_BPE

    return pack(table(spark, sf_dir, "documents"), tokenizer or WORD_BPE())
