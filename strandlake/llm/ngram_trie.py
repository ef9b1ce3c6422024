"""Operator 10: scoring with an n-gram trie in Elias-Fano levels.

Level 1 holds the words of the training texts in the order of their 64-bit hashes with their counts.
Level 2 holds, for each context word, the words that follow it. Words are numbers (ranks in level 1).
As in every Elias-Fano trie, the children of context i become one monotone sequence by adding
i * V to each; monotone pointers say where a context's children begin, and a query is a successor
search among the children of its context. Probabilities are absolute-discounting ones with one
discount for the corpus, quantised to 16 bits on a logarithmic scale. The levels lie in the shared folder in
files of consecutive ranges, which scoring tasks map into memory and read where needed. Level 2 is cut by
distinct pairs, so a frequent context lies in several files.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_batches, local_path, stage, table
from strandlake.llm.ngram_join import LOWER, sliced
from strandlake.llm.word_bpe import split_chunks
from strandlake.sources.staging import new_path

#: The end of a text, also the context of its first word.
END = np.uint64(0x8F3A61D2C47B905E)
#: Pairs that a task counts before it hands them on, and distinct pairs of one file of level 2.
BUFFER, SHARD_PAIRS = 2**21, 2**21
#: log10 of the least probability that quantisation tells from zero, and the steps from there to 1.
LEAST_LOG, STEPS = 9.0, 65_535
META = "first long, last long, n long, total long, head string"
#: Of a file of level 2 also the children that its first and last context have in it, and how often these contexts occur in all.
PAIR_META = META + ", first_n long, first_total long, last_n long, last_total long"


# ---- Elias-Fano sequences


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of width bits, one after the other, in 64-bit words (one spare word behind)."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, dtype=np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = shift + np.uint64(width) > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def unpack_bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), dtype=np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def elias_fano(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of unsigned numbers below universe."""
    n = len(values)
    width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + (max(1, universe) - 1 >> width) + 2
    bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
    low = pack_bits(values & np.uint64((1 << width) - 1), width)
    return {"low": low, "high": words, "zeros": zeros, "shape": np.array([n, width], dtype=np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.n, self.width = (int(x) for x in arrays["shape"])

    def select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0) among the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        rest, bits, place = k - self.zeros[word], ~self.high[word], np.zeros(len(k), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = rest >= inside
            rest = np.where(beyond, rest - inside, rest)
            place += np.where(beyond, step, 0)
            bits = np.where(beyond, bits >> np.uint64(step), bits)
        return word * 64 + place

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element >= x among places first .. last, whether it equals x)."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        low = x & np.uint64((1 << self.width) - 1)
        a = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        z = self.select0(high) - high
        if first is not None:
            a, z = np.maximum(a, first), np.minimum(z, last)
        end = z
        while (open_ := a < z).any():
            mid = (a + z) // 2
            less = open_ & (unpack_bits(self.low, np.minimum(mid, max(0, self.n - 1)), self.width) < low)
            a, z = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, z)
        return a, (a < end) & (unpack_bits(self.low, np.minimum(a, max(0, self.n - 1)), self.width) == low)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The elements at the places given, by search for the place among the high bits' ones."""
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))]) if not hasattr(self, "ones") else self.ones
        self.ones = ones
        word = np.minimum(np.searchsorted(ones, index, side="right") - 1, len(self.high) - 1)
        rest, bits, place = index - ones[word], self.high[word], np.zeros(len(index), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = rest >= inside
            rest = np.where(beyond, rest - inside, rest)
            place += np.where(beyond, step, 0)
            bits = np.where(beyond, bits >> np.uint64(step), bits)
        high = (word * 64 + place - index).astype(np.uint64)
        return (high << np.uint64(self.width)) | unpack_bits(self.low, index, self.width)


# ---- files of a level


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays to one file, whole or not at all, and returns what is needed to map it."""
    head, at, spare = {"path": path}, 0, f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(spare, "wb") as f:
        for name, x in arrays.items():
            f.write(b"\0" * (-at % 64))
            at += -at % 64
            head[name] = [x.dtype.str, at, len(x)]
            f.write(np.ascontiguousarray(x).data)
            at += x.nbytes
    os.replace(spare, path)
    return json.dumps(head)


@functools.lru_cache(maxsize=4096)
def map_arrays(head: str) -> dict[str, np.ndarray]:
    spec = json.loads(head)
    path = spec.pop("path")
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    return {k: np.asarray(whole[at : at + n * np.dtype(kind).itemsize]).view(kind) for k, (kind, at, n) in spec.items()}


def part(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)})


# ---- words


def token_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, how many each text has); each text ends with END."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = LOWER[np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]]
    _, _, hashes, n = split_chunks(data, bounds - bounds[0])
    return np.insert(hashes, np.cumsum(n), END), n + 1


def held_out(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of doc_id as text leaves 1 when divided by 5."""
    return np.array([zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1 for i in ids.to_pylist()], dtype=bool)


def count_words(docs: DataFrame) -> DataFrame:
    """w, c: how often each word occurs in the training texts; a task combines its batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, n = token_batch(b.column(1))
            w, c = np.unique(hashes[np.repeat(~held_out(b.column(0)), n)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    return docs.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def write_words(words: DataFrame, folder: str) -> list:
    """Level 1: one file for each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            t = pa.Table.from_batches(whole)
            w, c = t["w"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64)
            order = (w - w[0]).view(np.uint64)
            arrays = {f"w_{k}": v for k, v in elias_fano(order, int(order[-1]) + 1).items()} | {"c": c}
            head = write_arrays(f"{folder}/words-{TaskContext.get().partitionId():06d}", arrays)
            yield meta(META, w[0], w[-1], len(w), c.sum(), head)

    return words.repartitionByRange("w").sortWithinPartitions("w").mapInArrow(run, META).orderBy("first").collect()


def meta(schema: str, *values) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) if k == "string" else pa.array([int(v)], pa.int64()) for v, k in zip(values, kinds, strict=True)], list(names))


class Words:
    """Level 1, mapped."""

    def __init__(self, files: list[tuple]):
        self.files = files
        self.first = np.array([f[0] for f in files], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum([f[2] for f in files])]).astype(np.int64)
        self.size, self.total = int(self.base[-1]), int(sum(f[3] for f in files))

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each hash; -1 and 0 where the training texts don't have it."""
        number, counts = np.full(len(w), -1, dtype=np.int64), np.zeros(len(w), dtype=np.int64)
        order = np.argsort(w)
        cuts = [*np.searchsorted(w[order], self.first), len(w)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            some = order[a:z]
            some = some[w[some] <= self.files[k][1]]
            if len(some):
                arrays = map_arrays(self.files[k][4])
                at, found = part(arrays, "w_").successor((w[some] - self.first[k]).view(np.uint64))
                number[some[found]] = self.base[k] + at[found]
                counts[some[found]] = arrays["c"][at[found]]
        return number, counts

    def counts(self, low: int, high: int) -> np.ndarray:
        """How often the words of the numbers low .. high - 1 occur."""
        spans = [(max(low, a) - a, min(high, z) - a, f) for f, a, z in zip(self.files, self.base[:-1].tolist(), self.base[1:].tolist(), strict=True) if a < high and low < z]
        return np.concatenate([map_arrays(f[4])["c"][a:z] for a, z, f in spans])


# ---- pairs


def count_pairs(docs: DataFrame, files: list[tuple]) -> DataFrame:
    """key, c: context * V + word of each distinct pair and how often it occurs; a task combines what it holds before the shuffle, which deals by pair."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "c"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n_held = Words(files), [], 0
        for b in batches:
            hashes, n = token_batch(b.column(1))
            codes, distinct = pd.factorize(hashes)
            number = words.find(distinct.view(np.int64))[0][codes]
            end = words.find(np.array([END]).view(np.int64))[0]
            context = np.concatenate([end, number[:-1]])
            keep = np.repeat(~held_out(b.column(0)), n)
            held.append(context[keep] * words.size + number[keep])
            n_held += len(held[-1])
            if n_held >= BUFFER:
                yield from flush(held)
                held, n_held = [], 0
        if n_held:
            yield from flush(held)

    return docs.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def write_pairs(pairs: DataFrame, folder: str, files: list[tuple]) -> tuple[list, dict[int, float]]:
    """(level 2: one file for each range of pairs; the mass that contexts in several files leave to the lower order)."""
    told = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    discount = min(0.95, max(0.1, told.n1 / (told.n1 + 2 * told.n2))) if told.n1 else 0.5
    shards = max(1, -(-told.n // SHARD_PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            t, words = pa.Table.from_batches(whole), Words(files)
            keys, counts = t["key"].to_numpy(), t["c"].to_numpy()
            context = keys // words.size
            low, high = int(context[0]), int(context[-1]) + 1
            pointers = np.searchsorted(context, np.arange(low, high + 1))
            # every occurrence of a word is the context of one pair, as each text's end is the next one's start
            children, total = np.diff(pointers), words.counts(low, high)
            seen = quantise((counts - discount) / total[context - low])
            left = quantise(discount * children / total)
            arrays = {f"k_{k}": v for k, v in elias_fano((keys - low * words.size).view(np.uint64), (high - low) * words.size).items()}
            arrays |= {f"p_{k}": v for k, v in elias_fano(pointers.astype(np.uint64), len(keys) + 1).items()}
            head = write_arrays(f"{folder}/pairs-{TaskContext.get().partitionId():06d}", arrays | {"seen": seen, "left": left})
            yield meta(PAIR_META, low, high, len(keys), counts.sum(), head, children[0], total[0], children[-1], total[-1])

    held = [tuple(r) for r in pairs.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, PAIR_META).collect()]
    ends: dict[int, list] = {}
    for first, last, _, _, head, first_n, first_total, last_n, last_total in held:
        for c, n, total in {(first, first_n, first_total), (last - 1, last_n, last_total)}:
            ends.setdefault(c, []).append((n, total))
    split = {c: float(SCALE[quantise(np.array([discount * sum(n for n, _ in x) / x[0][1]]))[0]]) for c, x in sorted(ends.items()) if len(x) > 1}
    return sorted(held), split


def quantise(p: np.ndarray) -> np.ndarray:
    """0 for 0, else steps of equal ratio from 10 ** -LEAST_LOG to 1."""
    logs = np.log10(np.maximum(p, 10**-LEAST_LOG))
    return np.where(p > 0, 1 + np.round((logs + LEAST_LOG) / LEAST_LOG * (STEPS - 1)), 0).astype(np.uint16)


SCALE = np.concatenate([[0.0], 10 ** (np.arange(STEPS) / (STEPS - 1) * LEAST_LOG - LEAST_LOG)])


def pair_parts(files: list[tuple], split: tuple[np.ndarray, np.ndarray], keys: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the pair where seen, mass left to the lower order) of sorted distinct context * V + word; split: contexts in several files, their mass."""
    seen, left = np.zeros(len(keys)), np.ones(len(keys))
    context, word = keys // vocabulary, keys % vocabulary
    cuts = np.searchsorted(context, [x for f in files for x in (f[0], f[1])]).reshape(-1, 2) if files else []
    for f, (a, z) in zip(files, cuts, strict=True):
        if a == z:
            continue
        arrays = map_arrays(f[4])
        own = context[a:z] - f[0]
        pointers = part(arrays, "p_")
        first, last = pointers.at(own).astype(np.int64), pointers.at(own + 1).astype(np.int64)
        at, found = part(arrays, "k_").successor((own * vocabulary + word[a:z]).view(np.uint64), first, last)
        seen[a:z] = np.where(found, SCALE[arrays["seen"][np.where(found, at, 0)]], seen[a:z])
        left[a:z] = np.where(last > first, SCALE[arrays["left"][own]], left[a:z])
    if len(split[0]):
        at = np.minimum(np.searchsorted(split[0], context), len(split[0]) - 1)
        left = np.where(split[0][at] == context, split[1][at], left)
    return seen, left


def score(docs: DataFrame, word_files: list[tuple], pair_files: list[tuple], split: dict[int, float]) -> DataFrame:
    apart = np.array(list(split), dtype=np.int64), np.array(list(split.values()), dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(word_files)
        v, n_train = words.size, words.total
        for b in batches:
            hashes, n = token_batch(b.column(1))
            codes, distinct = pd.factorize(hashes)
            number, count = words.find(distinct.view(np.int64))
            base = (count + 0.5) / (n_train + 0.5 * (v + 1))
            number, end = number[codes], words.find(np.array([END]).view(np.int64))[0]
            context = np.concatenate([end, number[:-1]])
            p = base[codes]
            known = np.flatnonzero(context >= 0)
            # a word that no training text has can't follow any context there: the number V stands for it
            keys = context[known] * (v + 1) + np.where(number[known] >= 0, number[known], v)
            order, distinct_keys = pd.factorize(keys, sort=True)
            c, w = distinct_keys // (v + 1), distinct_keys % (v + 1)
            seen, left = pair_parts(pair_files, apart, c * v + np.minimum(w, v - 1), v)
            seen = np.where(w < v, seen, 0.0)
            p[known] = seen[order] + left[order] * p[known]
            starts = np.cumsum(n) - n
            sums = [np.add.reduceat(x, starts) if len(n) else np.zeros(0) for x in (np.log10(base)[codes], np.log10(p), (count[codes] > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(held_out(b.column(0))), pa.array(n), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(n), n_train)), pa.array(sums[0]), pa.array(sums[1])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty; an empty text is its end token alone. Repeated rows count as often as
    they occur. Without training texts every probability is that of the base formula. The model needs
    a shared folder that tasks can open as files (spark.checkpoint.dir on a mounted file system).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    folder = local_path(new_path(spark, "op10-levels"))
    if folder is None:
        raise ValueError("the n-gram trie is mapped into memory: spark.checkpoint.dir must be on a mounted file system")
    words = [tuple(r) for r in write_words(stage(count_words(docs), "op10-words"), folder)]
    pairs, split = write_pairs(stage(count_pairs(docs, words), "op10-pairs"), folder, words) if words else ([], {})
    return score(docs, words, pairs, split)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))
