"""Operator 11: importance resampling of documents towards a target distribution.

Runs of words are features, hashed to buckets. The gain of a bucket is the logarithm of its share in
the target texts over that in all documents; a document's weight is the sum of its features' gains, and
noise by doc_id turns the highest scores into a draw without replacement. Each batch interns its
n-grams in an open-addressed NumPy table under xxhash64 keys; equal keys count as equal n-grams only if
their bytes are. A slot stores bucket and count, and the slots of the occurrences gather the gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_batches, stage, table
from strandlake.llm.word_bpe import flatten

#: Fixed by the contract of the query.
WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Fixed values of the XXH64 hash function.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Shorter n-grams are hashed and compared as 8-byte lanes side by side, others one by one.
SHORT = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing; those from 0x80 belong to characters beyond ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64_short(lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of byte strings shorter than 32, given as four little-endian lanes padded with zeros."""
    h = P5 + lengths.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero(lengths >= 8 * k + 8)
        h[at] = rotated(h[at] ^ rotated(lanes[at, k] * P2, 31) * P1, 27) * P1 + P4
    whole, left = lengths // 8, lengths % 8
    tail = lanes[np.arange(len(lengths)), np.minimum(whole, 3)]
    at = np.flatnonzero(left >= 4)
    h[at] = rotated(h[at] ^ (tail[at] & np.uint64(2**32 - 1)) * P1, 23) * P2 + P3
    for k in range(3):
        at = np.flatnonzero(left % 4 > k)
        byte = tail[at] >> (8 * (left[at] // 4 * 4 + k)).astype(np.uint64) & np.uint64(255)
        h[at] = rotated(h[at] ^ byte * P5, 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


class Interned:
    """An open-addressed table of byte strings with linear probing. Strings lie in one buffer; a slot has key, string, bucket and count."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int, step: int = 2**17):
        self.data, self.starts, self.lengths, self.buckets = data, starts, lengths, buckets
        padded = np.concatenate([data, np.zeros(40, dtype=np.uint8)])
        self.eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place
        self.used = 0
        self._resize(2**12)
        self.slots = np.empty(len(starts), dtype=np.int64)
        for i in range(0, len(starts), step):
            self._intern(i, min(len(starts), i + step))

    def _resize(self, size: int) -> None:
        old = getattr(self, "owner", None)
        old_slots = np.flatnonzero(old >= 0) if old is not None else np.zeros(0, dtype=np.int64)
        held = (self.key[old_slots], old[old_slots], self.bucket[old_slots], self.count[old_slots]) if old is not None else ()
        self.key, self.owner = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int64)
        self.bucket, self.count = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int64)
        if len(old_slots):
            moved = np.full(len(old), -1, dtype=np.int64)
            left, at = np.arange(len(old_slots)), (held[0] & np.uint64(size - 1)).astype(np.int64)
            while len(left):
                free = self.owner[at] < 0
                self.owner[at[free]] = held[1][left[free]]  # of several that claim a slot the last one gets it
                got = free & (self.owner[at] == held[1][left])
                moved[old_slots[left[got]]] = at[got]
                left, at = left[~got], (at[~got] + 1) & (size - 1)
            to = moved[old_slots]
            self.key[to], self.bucket[to], self.count[to] = held[0], held[2], held[3]
            done = self.slots[: self.done]
            self.slots[: self.done] = moved[done]

    def _hashed(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and lanes of some strings; long ones have their keys from the library and no lanes."""
        starts, lengths = self.starts[first:last], self.lengths[first:last]
        short = lengths < SHORT
        lanes = np.zeros((len(starts), 4), dtype=np.uint64)
        for k in range(4):
            at = np.flatnonzero(short & (lengths > 8 * k))
            lanes[at, k] = self.eight[starts[at] + 8 * k] & LOW_BYTES[np.minimum(lengths[at] - 8 * k, 8)]
        keys = xxh64_short(lanes, np.where(short, lengths, 0))
        for i in np.flatnonzero(~short).tolist():
            keys[i] = xxhash.xxh64_intdigest(self.of(first + i))
        return keys, lanes

    def of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def _equal(self, mine: np.ndarray, lanes: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Whether strings equal those that own their slots, byte by byte."""
        lengths = self.lengths[mine]
        same = lengths == self.lengths[owners]
        for k in range(4):
            at = np.flatnonzero(same & (lengths < SHORT) & (lengths > 8 * k))
            same[at] = lanes[at, k] == self.eight[self.starts[owners[at]] + 8 * k] & LOW_BYTES[np.minimum(lengths[at] - 8 * k, 8)]
        for i in np.flatnonzero(same & (lengths >= SHORT)).tolist():
            same[i] = self.of(mine[i]) == self.of(owners[i])
        return same

    def _intern(self, first: int, last: int) -> None:
        self.done = first
        while 2 * (self.used + last - first) > len(self.key):  # at most half full, even if all are new
            self._resize(2 * len(self.key))
        keys, lanes = self._hashed(first, last)
        size = len(self.key)
        left, at = np.arange(last - first), (keys & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = self.owner[at] < 0
            if free.any():
                self.owner[at[free]] = first + left[free]  # of several that claim a slot the last one gets it
                new = np.flatnonzero(free & (self.owner[at] == first + left))
                self.key[at[new]] = keys[left[new]]
                self.bucket[at[new]] = [zlib.crc32(self.of(i)) % self.buckets for i in (first + left[new]).tolist()]
                self.used += len(new)
            same = self.key[at] == keys[left]
            check = np.flatnonzero(same)
            same[check] = self._equal(first + left[check], lanes[left[check]], self.owner[at[check]])
            self.slots[first + left[same]] = at[same]
            left, at = left[~same], (at[~same] + 1) & (size - 1)
        np.add.at(self.count, self.slots[first:last], 1)
        self.done = last

    def bucket_counts(self) -> np.ndarray:
        """How many occurrences each bucket has."""
        return np.bincount(self.bucket[self.owner >= 0], weights=self.count[self.owner >= 0], minlength=self.buckets).astype(np.int64)


def features(column: pa.Array, n_max: int, buckets: int) -> tuple[Interned, np.ndarray, np.ndarray]:
    """(interned n-grams of an Arrow column of texts, how many occurrences and how many words each text has). Null counts as empty.

    Occurrences are ordered by text. For runs of several words the words are laid out again with one space between.
    """
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = LOWER[np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = INSIDE[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cuts = bounds[:-1][(bounds[:-1] < len(data)) & (bounds[1:] > bounds[:-1])]
    edge[cuts] = inside[cuts]
    starts = np.flatnonzero(edge)
    stop = np.empty(len(data), dtype=bool)
    stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:])
    stop[-1:] = inside[-1:]
    lengths = np.flatnonzero(stop) + 1 - starts
    words = np.diff(np.searchsorted(starts, bounds))
    if n_max == 1:
        return Interned(data, starts, lengths, buckets), words, words
    data = np.append(data, np.uint8(32))[flatten(lengths + 1, starts)]
    ends = np.cumsum(lengths + 1)
    data[ends - 1], starts = 32, ends - 1 - lengths
    text_of = np.repeat(np.arange(len(words)), words)
    parts = []
    for n in range(1, n_max + 1):
        at = np.arange(max(0, len(starts) - n + 1))
        at = at[text_of[at] == text_of[at + n - 1]]
        parts.append((text_of[at], starts[at], ends[at + n - 1] - 1 - starts[at]))
    texts, begins, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(texts, kind="stable")
    return Interned(data, begins[order], sizes[order], buckets), np.bincount(texts, minlength=len(words)), words


def bucket_totals(docs: DataFrame, n_max: int = WORDS, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Occurrences in each bucket over all rows. A task adds up its own, so at most a row a bucket and task is shuffled and a row a bucket returned."""
    arrow_batches(docs.sparkSession, "3m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                total += features(b.column(0), n_max, buckets)[0].bucket_counts()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    held = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in held.collect():  # a row a bucket at most
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in pairs], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, n_max: int = WORDS) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row. gains: of each bucket."""
    arrow_batches(docs.sparkSession, "3m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            interned, per_text, words = features(b.column(1), n_max, len(gains))
            ahead = np.concatenate([[0], np.cumsum(gains[interned.bucket[interned.slots]])])
            ends = np.concatenate([[0], np.cumsum(per_text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(per_text, pa.int64()), pa.array(words, pa.int64()), pa.array(ahead[ends[1:]] - ahead[ends[:-1]], pa.int64())], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(seed: int = SEED, key: str = "doc_id") -> Column:
    """Gumbel noise in thousandths by the digest of seed and key; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank from 1 of the highest floor(percent / 100) of the rows; the others' is null. scored has these and n_words.

    Ties go to the smaller doc_id, a null one last, then to fewer features. Rows are numbered in range
    partitions; a row a partition tells how many lie ahead.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"]
    held = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    held = stage(held.select("*", F.shiftright("row", 33).alias("part")).withColumn("row", F.expr("row & ((1L << 33) - 1)")), "op11-order")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    parts = sizes.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("ahead"), F.expr(f"({percent} * sum(n) over ()) div 100").alias("drawn"))
    place = F.col("row") + F.col("ahead") + 1
    return held.join(F.broadcast(parts), "part").select("doc_id", "n_features", "weight", "score", F.when(place <= F.col("drawn"), place).alias("rank"))  # one row a partition


def resample(docs: DataFrame, target: DataFrame, n_max: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; percent of the rows with enough words are drawn towards the texts of target.

    A null text has no words and weight 0; rows that share a doc_id have the same noise and are ranked each;
    an empty table gives no rows, an empty target the gains of smoothing alone. docs: doc_id, text; target: text.
    """
    gains = gains_of(bucket_totals(docs, n_max, buckets), bucket_totals(target, n_max, buckets))
    scored = stage(weigh(docs, gains, n_max).withColumn("score", F.col("weight") + noise(seed)), "op11-scored")
    few = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(F.col("n_words") >= least_words), percent).unionByName(few)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: DuckDB SQL for the rows of op11_resampling; each distinct word's CRC-32 is taken byte by byte.
OP11_SQL = f"""WITH RECURSIVE bits AS (SELECT b, b AS v, 0 AS i FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM bits WHERE i < 8),
d AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w, row_number() OVER () AS rid FROM documents), b AS MATERIALIZED (SELECT {_WORDS_SQL} AS w FROM benchmark),
o AS MATERIALIZED (SELECT rid, unnest(w) AS x FROM d), u AS MATERIALIZED (SELECT unnest(w) AS x FROM b),
crcs AS (SELECT x, hex(encode(x)) AS y, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT x FROM o UNION SELECT x FROM u)
UNION ALL SELECT x, y, crcs.k + 1, xor(c // 256, bits.v) FROM crcs JOIN bits ON bits.i = 8 AND bits.b = xor(c % 256, ('0x' || substr(y, 2 * crcs.k + 1, 2))::BIGINT) WHERE 2 * crcs.k < length(y)),
h AS MATERIALIZED (SELECT x, xor(c, 4294967295) % {BUCKETS} AS bucket FROM crcs WHERE 2 * k = length(y)),
s AS (SELECT bucket, count(*) AS s FROM o JOIN h USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM u JOIN h USING (x) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM o) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
e AS (SELECT rid, sum(gain)::BIGINT AS weight FROM o JOIN h USING (x) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h FROM d LEFT JOIN e USING (rid)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM z),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM r WHERE place IS NOT NULL) // 100 THEN place END AS rank FROM r"""
