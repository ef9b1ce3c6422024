"""K-mers of up to 31 bases as two bits a base in a long: counted and looked up in slices where they lie, so only longs are shuffled."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bases that are packed and counted together: bounds a task's memory, whatever the length of sequences.
SLICE = 1 << 20
#: Code of each byte, 4 for all that is no base. In the order of codes k-mers ascend as they do as strings.
CODES = np.full(256, 4, np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    CODES[[ord(x) for x in _letters]] = _code
#: The same for text in small letters as dna_of_text() reads it: 5 for what is left out.
LETTERS = np.full(256, 5, np.uint8)
LETTERS[ord("a") : ord("z") + 1] = np.arange(26) % 4
#: Bases looked up together.
PIECE = 1 << 18
#: Sets of k-mers of at most so many bases, of at most so many samples, are kept as a flag for each possible k-mer by a task; so many are sent as one row.
DENSE_K, DENSE_SAMPLES, DENSE_ROW = 12, 16, 1 << 15


def pack(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all windows of k bases (0 to 3) on both strands, doubled from shorter windows."""
    kind = np.int32 if k <= 15 else np.int64
    forward, back = bases.astype(kind), 3 - bases.astype(kind)
    size = 1
    for bit in bin(k)[3:]:
        n = len(forward) - size
        forward, back = (forward[:n] << 2 * size) | forward[size:], (back[size:] << 2 * size) | back[:n]
        size *= 2
        if bit == "1":
            one = bases[size:].astype(kind)
            forward, back = (forward[: len(one)] << 2) | one, ((3 - one) << 2 * size) | back[: len(one)]
            size += 1
    return forward, back


def other_strand(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements: pairs of bits are turned round in a 64-bit word."""
    x = ~codes.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def canonical_codes(codes: np.ndarray, k: int) -> np.ndarray:
    return np.minimum(codes, other_strand(codes, k))


def flattened(column: pa.Array, table: np.ndarray = CODES) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all sequences of a column without nulls one behind another, and where each begins, with the end of the last."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    bases = table[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    if table is not CODES:
        kept = bases != 5
        ends = np.concatenate(([0], np.cumsum(kept)))[ends]
        bases = bases[kept]
    return bases, ends


def _windows(flat: np.ndarray, ends: np.ndarray, k: int, piece: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(at, good, code, code on the other strand) of every piece: good tells which windows are k valid bases of one sequence."""
    for at in range(0, len(flat), piece):
        bases = flat[at : at + piece + k - 1]
        if len(bases) < k:
            return
        wrong = np.concatenate(([0], np.cumsum(bases == 4, dtype=np.int32)))
        good = wrong[k:] == wrong[:-k]
        # a window that crosses the end of a sequence is none: such windows begin within k - 1 bases before an end
        inner = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(bases), "left")] - at
        for back in range(1, k):
            near = inner - back
            good[near[(near >= 0) & (near < len(good))]] = False
        yield at, good, *pack(bases & 3, k)


def _slices(column: pa.Array, k: int, table: np.ndarray = CODES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, n, own) of the distinct canonical k-mers of each slice; own: the k-mer is its own other strand."""
    flat, ends = flattened(column.drop_null(), table)
    for _, good, forward, other in _windows(flat, ends, k, SLICE):
        codes, n = np.unique(np.minimum(forward, other)[good], return_counts=True)
        own = np.zeros(len(codes), bool)
        if k % 2 == 0:
            own[np.searchsorted(codes, np.unique(forward[good & (forward == other)]))] = True
        yield codes.astype(np.int64), n, own


def counts(reads: DataFrame, k: int, seq: str = "seq", table: np.ndarray = CODES, more: tuple[tuple[DataFrame, int], ...] = ()) -> DataFrame:
    """code, n, own: how often each canonical k-mer occurs, and whether it is its own other strand. Any other character breaks a window.

    more: other reads, each with the number of times that they are there.

    Every slice of a task is counted before rows leave Python, so a frequent k-mer is one row a slice; null,
    empty and short sequences give no rows. k: 1 to 31.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, n, own in _slices(batch.column(0), k, table):
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64)), pa.array(own)], ["code", "n", "own"])

    part = reads.select(seq).mapInArrow(counted, "code long, n long, own boolean")
    for others, times in more:
        part = part.unionByName(others.select(seq).mapInArrow(counted, "code long, n long, own boolean").withColumn("n", F.col("n") * times))
    return part.groupBy("code").agg(F.sum("n").alias("n"), F.first("own").alias("own"))


def distinct(reads: DataFrame, k: int, seq: str = "seq", table: np.ndarray = CODES, prefixes: DataFrame | None = None, length: int = 0) -> DataFrame:
    """code of each canonical k-mer, once; with prefixes (code, of so many bases) of those that begin with one."""
    wanted = None
    if prefixes is not None:
        flags = np.zeros(4**length, bool)
        flags[[r.code for r in prefixes.select("code").distinct().collect()]] = True  # 4**length numbers at most
        wanted = reads.sparkSession.sparkContext.broadcast(flags)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = flattened(batch.column(0).drop_null(), table)
            for _, good, forward, other in _windows(flat, ends, k, SLICE):
                codes = np.minimum(forward, other)[good]
                if wanted is not None:
                    codes = codes[wanted.value[codes >> 2 * (k - length)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(codes).astype(np.int64))], ["code"])

    return reads.select(seq).mapInArrow(coded, "code long").distinct()


def windows(reads: DataFrame, k: int, key: str, seq: str = "seq", table: np.ndarray = CODES) -> DataFrame:
    """key, code of the canonical k-mer of each window."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            flat, ends = flattened(batch.column(1), table)
            for at, good, forward, other in _windows(flat, ends, k, SLICE):
                own = np.searchsorted(ends, at + np.flatnonzero(good), "right") - 1
                codes = np.minimum(forward, other)[good].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(codes)], [key, "code"])

    return reads.select(key, seq).mapInArrow(coded, T.StructType([reads.schema[key], T.StructField("code", T.LongType())]))


def code_of(kmer: Column | str) -> Column:
    """The code of a k-mer in large letters."""
    return F.conv(F.translate(F.col(kmer) if isinstance(kmer, str) else kmer, "ACGT", "0123"), 4, 10).cast("long")


class Sorted:
    """Values of a few codes: a table of hashes rules most others out."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = 64 - max(10, int(16 * max(1, len(codes))).bit_length())
        self.maybe = np.zeros(1 << (64 - self.shift), bool)
        self.maybe[self._hash(self.codes)] = True

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the codes that are there."""
        at = np.flatnonzero(self.maybe[self._hash(codes)])
        if not len(at) or not len(self.codes):
            return at[:0], self.values[:0]
        sought = codes[at].astype(np.int64)
        place = np.minimum(np.searchsorted(self.codes, sought), len(self.codes) - 1)
        there = self.codes[place] == sought
        return at[there], self.values[place[there]]


class Mapped:
    """The same for very many codes of a k up to 15: a bit for each k-mer and, by rank of their bits, values, in files that tasks map."""

    def __init__(self, folder: str, starts: list[int], kind: str):
        self.folder, self.starts, self.kind = folder, starts, kind
        self.bits = None

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.bits is None:
            self.bits = np.memmap(f"{self.folder}/bits", np.uint64, "r")
            self.ranks = np.memmap(f"{self.folder}/ranks", np.uint32, "r")
            self.values = np.memmap(f"{self.folder}/values", self.kind, "r")
            self.ahead = np.array(self.starts, np.int64)
        words, bit = self.bits[codes >> 6], (codes & 63).astype(np.uint64)
        at = np.flatnonzero((words >> bit) & np.uint64(1))
        sought, before = codes[at], (np.uint64(1) << bit[at]) - np.uint64(1)
        rank = self.ahead[sought >> CHUNK] + self.ranks[sought >> 6] + np.bitwise_count(words[at] & before)
        return at, self.values[rank]


#: Bits of the codes that one task writes the files of; rows of an index up to which it is sent to every task.
CHUNK, FEW = 21, 1 << 20


def lookup(index: DataFrame, k: int, folder: Callable[[], str | None]) -> Sorted | Mapped | None:
    """A table of a staged index (code, value: distinct codes, values from 0), or None where it is neither small nor k up to 15.

    A small one is sent to every task. Of a large one tasks write their share of three files in folder(), which all tasks must be able
    to map; without such a folder there is no table either.
    """
    told = index.agg(F.count("*").alias("n"), F.max("value").alias("top")).first()
    if told.n <= FEW:
        held = index.toArrow().combine_chunks() if told.n else None
        codes, values = (np.empty(0, np.int64), np.empty(0, np.int64)) if held is None else (held.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        return Sorted(codes, values)
    if k > 15 or told.top > np.iinfo("uint32").max or (path := folder()) is None:
        return None
    kind = next(x for x in ("uint8", "uint16", "uint32") if told.top <= np.iinfo(x).max)
    sizes = {r.chunk: r.n for r in index.groupBy(F.shiftright("code", CHUNK).alias("chunk")).agg(F.count("*").alias("n")).collect()}  # at most 512 rows
    starts = [0]
    for chunk in range(max(1, 4**k >> CHUNK)):
        starts.append(starts[-1] + sizes.get(chunk, 0))
    last = max(sizes)
    os.makedirs(path, exist_ok=True)
    for name, size in (("bits", 4**k // 8), ("ranks", 4**k // 16), ("values", told.n * np.dtype(kind).itemsize)):
        with open(f"{path}/{name}", "wb") as f:
            f.truncate(size)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().astype(kind)) for b in batches]
        if not parts:
            return
        codes, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(codes)
        codes, values = codes[order], values[order]
        bounds = np.flatnonzero(np.diff(codes >> CHUNK, prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(codes)], strict=True):
            chunk = int(codes[a]) >> CHUNK
            bits = np.zeros(1 << CHUNK, np.uint8)
            bits[codes[a:b] & ((1 << CHUNK) - 1)] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = np.cumsum(np.bitwise_count(words), dtype=np.uint32) - np.bitwise_count(words)
            for name, at, array in (("bits", chunk << CHUNK >> 3, words), ("ranks", chunk << CHUNK >> 4, ranks.astype(np.uint32)), ("values", starts[chunk] * values.itemsize, values[a:b])):
                with open(f"{path}/{name}", "r+b") as f:
                    f.seek(at)
                    f.write(array.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(codes)])], ["n"])

    dealt = index.select("code", "value").repartition(min(last + 1, 256), F.shiftright("code", CHUNK))
    done = dealt.mapInArrow(written, "n long").agg(F.sum("n").alias("n")).first().n
    assert done == told.n
    return Mapped(path, starts, kind)


def found(reads: DataFrame, table: Sorted | Mapped, k: int, key: str = "read_id", seq: str = "seq", letters: np.ndarray = CODES) -> DataFrame:
    """key, value of the table for each k-mer of a read that it has, on either strand; few rows are told again."""
    sent = reads.sparkSession.sparkContext.broadcast(table)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            flat, ends = flattened(batch.column(1), letters)
            rows, values = [], []
            for at, good, forward, other in _windows(flat, ends, k, PIECE):
                windows = np.flatnonzero(good)
                place, value = held.find(np.minimum(forward, other)[windows])
                if len(place):
                    row = np.searchsorted(ends, at + windows[place], "right") - 1
                    own, at_value = np.unique(value, return_inverse=True)
                    both = np.unique((row - row[0]) * len(own) + at_value)
                    rows.append(row[0] + both // len(own))
                    values.append(own[both % len(own)].astype(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(values))], [key, "value"])

    return reads.select(key, seq).mapInArrow(looked_up, T.StructType([reads.schema[key], T.StructField("value", T.LongType())]))


def unpack(code: Column | str, k: int) -> Column:
    """The k-mer of a code."""
    code = F.col(code) if isinstance(code, str) else code
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def letters_of(codes: np.ndarray, k: int) -> pa.Array:
    """The k-mers of codes as strings, six bases at a time."""
    bases = np.frombuffer(b"ACGT", np.uint8)
    out, at = np.empty((len(codes), k), np.uint8), k
    while at > 0:
        n = min(6, at)
        every = bases[(np.arange(4**n)[:, None] >> 2 * np.arange(n - 1, -1, -1)[None, :]) & 3]
        out[:, at - n : at] = every[(codes >> 2 * (k - at)) & (4**n - 1)]
        at -= n
    ends = np.arange(len(codes) + 1, dtype=np.int64) * k
    return pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def unpacked(coded: DataFrame, k: int, name: str = "kmer") -> DataFrame:
    """coded with the k-mer in place of its code, for many rows."""
    others = [f for f in coded.schema.fields if f.name != "code"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], letters_of(batch.columns[-1].to_numpy(), k)], [*(f.name for f in others), name])

    return coded.select(*(f.name for f in others), "code").mapInArrow(told, T.StructType([*others, T.StructField(name, T.StringType())]))


def sample_sets(reads: DataFrame, k: int, sample: str, seq: str = "seq", table: np.ndarray = CODES) -> DataFrame:
    """sample, code of each canonical k-mer of each sample, once.

    Where k and the number of samples are small, a task flags what it finds and sends flags as bits, so what is shuffled
    is bounded by tasks and not by windows; else codes are sent.
    """
    reads = reads.where(F.col(seq).isNotNull())
    if k > DENSE_K or len(reads.select(sample).distinct().limit(DENSE_SAMPLES + 1).collect()) > DENSE_SAMPLES:
        return windows(reads, k, sample, seq, table).distinct()
    size, row = 4**k, min(4**k, DENSE_ROW)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict = {}
        for batch in batches:
            for name in batch.column(0).unique():
                mine = pc.is_null(batch.column(0)) if not name.is_valid else pc.fill_null(pc.equal(batch.column(0), name), False)
                flat, ends = flattened(batch.column(1).filter(mine), table)
                held = flags.setdefault(name.as_py(), np.zeros(size, bool))
                for _, good, forward, other in _windows(flat, ends, k, PIECE):
                    held[np.minimum(forward, other)[good]] = True
        for name, held in flags.items():
            for at in range(0, size, row):
                if held[at : at + row].any():
                    yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([at // row], pa.int32()), pa.array([np.packbits(held[at : at + row]).tobytes()])], [sample, "part", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for batch in batches:
            for name, part, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.frombuffer(bits, np.uint8)
                sets[name, part] = sets[name, part] | bits if (name, part) in sets else bits
        for (name, part), bits in sets.items():
            codes = np.flatnonzero(np.unpackbits(bits)[:row]) + part * row
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, kind), len(codes)), pa.array(codes.astype(np.int64))], [sample, "code"])

    field = reads.schema[sample]
    kind = to_arrow_type(field.dataType)
    parts = reads.select(sample, seq).mapInArrow(flagged, T.StructType([field, T.StructField("part", T.IntegerType()), T.StructField("bits", T.BinaryType())]))
    return parts.repartition(sample, "part").mapInArrow(joined, T.StructType([field, T.StructField("code", T.LongType())]))


def pair_measures(reads: DataFrame, key: str, seq: str = "seq", table: np.ndarray = LETTERS) -> DataFrame:
    """key, entropy, period2 of each sequence: base-2 entropy of its dinucleotides (0 below two bases) and the share of bases equal to the one two places before (0 below three).

    What is no base counts as one more.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = flattened(pc.fill_null(batch.column(1), ""), table)
            n = len(ends) - 1
            entropy, alike = np.zeros(n), np.zeros(n)
            sizes = np.diff(ends)
            first = 0
            while first < n:  # whole sequences, of some PIECE bases together
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
                bases = flat[ends[first] : ends[last]]
                own = np.repeat(np.arange(last - first), sizes[first:last])
                inside = own[1:] == own[:-1]
                pairs = np.bincount((own[1:] * 25 + bases[:-1] * 5 + bases[1:])[inside], minlength=25 * (last - first)).reshape(-1, 25)
                share = pairs / np.maximum(1, pairs.sum(1, keepdims=True))
                entropy[first:last] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
                same = (own[2:] == own[:-2]) & (bases[2:] == bases[:-2])
                alike[first:last] = np.bincount(own[2:][same], minlength=last - first)
                first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entropy), pa.array(np.where(sizes < 3, 0.0, alike / np.maximum(1, sizes - 2)))], [key, "entropy", "period2"])

    return reads.select(key, seq).mapInArrow(measured, T.StructType([reads.schema[key], T.StructField("entropy", T.DoubleType()), T.StructField("period2", T.DoubleType())]))


def histogram(counted: DataFrame) -> DataFrame:
    """multiplicity, n of the graph with both strands of what counts() found: a k-mer that is its own other strand is one edge with twice the count."""
    held = counted.groupBy((F.col("n") * F.when(F.col("own"), 2).otherwise(1)).alias("multiplicity"))
    return held.agg(F.sum(F.when(F.col("own"), 1).otherwise(2)).alias("n"))


def by_prefix(counted: DataFrame, k: int, length: int) -> DataFrame:
    """prefix, n, low, high of the set: k-mers by their first bases, without unpacking more than a row a prefix."""
    held = counted.groupBy(F.shiftright("code", 2 * (k - length)).alias("p")).agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))
    return held.select(unpack("p", length).alias("prefix"), "n", unpack("low", k).alias("low"), unpack("high", k).alias("high"))
