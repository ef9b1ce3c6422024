"""Operator 13: byte-level BPE by a queue of ranks under a hierarchical bitmap.

Adjacent pairs lie in one bucket for each merge rank. Three levels of 64-bit words say which buckets hold
something, so find-first-set on each level gives the lowest rank, however many ranks and pairs there are.
Within a bucket the leftmost position comes first. Symbols are a linked list over byte positions; a merge
only adds its two new pairs, and entries whose pair has changed meanwhile are skipped when they come up.
A pre-token of n bytes takes O(n log n) steps, so very long ones do no harm. Short ones share a queue.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_batches, table
from strandlake.llm.word_bpe import Encoded, flatten


#: Marks pre-tokens of texts that are split by stand-ins; a lone surrogate is in no text.
MARK = "\ud800"
#: A letter, a number and a character of neither kind, of which no version of Unicode thinks otherwise.
STAND_INS = {"L": "\u00e9", "N": "\u00b2", "": "\u2603"}


def stand_ins(pattern: str) -> dict[int, str]:
    """Code points that the library's version of Unicode takes for another kind than this one's splitter, and what to split by instead.

    Only characters on which the two versions of Unicode at hand differ are put to the library: a
    vocabulary that has each before a letter and before a digit tells by one token what it splits together.
    """
    if not (r"\p{L}" in pattern and r"\p{N}" in pattern):
        return {}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    here = {c: kind for kind in "LN" for c in regex.findall(rf"\p{{{kind}}}", every)}
    there = {c: kind for c in every if (kind := unicodedata.category(c)[0]) in "LN"}
    unsettled = sorted(c for c in here.keys() | there.keys() if here.get(c) != there.get(c))
    tokens = [bytes([b]) for b in range(256)] + [(c + tail).encode() for c in unsettled for tail in "a1"]
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    kinds = {c: "L" if len(probe.encode_ordinary(c + "a")) == 1 else "N" if len(probe.encode_ordinary(c + "1")) == 1 else "" for c in unsettled}
    return {ord(c): STAND_INS[kind] for c, kind in kinds.items() if kind != here.get(c, "")}


class RankQueue:
    """Buckets of positions by rank, lowest rank first."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 64**2 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Puts in a bucket of its own rank; a rank that has one already takes positions by self.buckets[rank].append()."""
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right; the queue must not be empty, as its truth value tells."""
        m = (self.top & -self.top).bit_length() - 1
        bits = self.mid[m]
        word = (m << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.mid[m] = bits = self.mid[m] & (self.mid[m] - 1)
            if not bits:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket

    def __bool__(self) -> bool:
        return bool(self.top)


class Known(dict):
    """Numbers pre-tokens in order of first sight; fresh lists those since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class ByteBpe:
    """Encodes as the tiktoken library with a rank file and a pattern, without special tokens."""

    #: Pre-tokens kept for the batches to come; those seen first stay, as frequent ones come early.
    MOST_KNOWN = 300_000
    #: A text with more characters is split piece by piece.
    LONG = 2**20
    #: Bytes of new pre-tokens that share a queue.
    TOGETHER = 2**18

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.size = max(self.ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.find = regex.compile(pattern)
        # for ASCII texts the letter and number classes are ranges, which the standard module scans faster
        self.find_plain = re.compile(pattern.replace(r"\p{L}+", "[A-Za-z]+").replace(r"\p{N}+", "[0-9]+").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.instead = stand_ins(pattern)
        self.doubtful = frozenset(map(chr, self.instead))
        self.token_bytes = [b""] * self.size
        self.of_two = np.full(2**16, -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
            if len(token) == 2:
                self.of_two[token[0] << 8 | token[1]] = rank
        self.decimal = [str(i).encode() for i in range(self.size)]
        self.shown = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.shown_lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.shown_starts = np.cumsum(self.shown_lengths) - self.shown_lengths
        self.known = Known()
        self.pool, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token: one that is a token itself stays whole, else the lowest rank merges first, the leftmost of equals.

        Those of a group lie one after the other and share one queue: as no pair crosses their borders, each
        still sees its own ranks in order.
        """
        whole = list(map(self.ranks.get, pieces))
        out = [[r] for r in whole]  # type: ignore[misc]
        rest = [i for i, r in enumerate(whole) if r is None]
        first = 0
        while first < len(rest):
            last, held = first, 0
            while last < len(rest) and (last == first or held + len(pieces[rest[last]]) <= self.TOGETHER):
                held += len(pieces[rest[last]])
                last += 1
            some = rest[first:last]
            for i, ids in zip(some, self._merge_group([pieces[i] for i in some]), strict=True):
                out[i] = ids
            first = last
        return out

    def _merge_group(self, pieces: list[bytes]) -> list[list[int]]:
        data, rank_of, queue = b"".join(pieces), self.ranks.get, self.queue
        n, buckets = len(data), queue.buckets
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.cumsum(lengths) - lengths
        border = np.zeros(n + 1, dtype=np.uint8)  # where a piece begins
        border[starts], border[n] = 1, 1
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        first = np.full(n, -1, dtype=np.int64)
        first[:-1] = np.where(border[1:n] == 0, self.of_two[raw[:-1] << 8 | raw[1:]], -1)
        pair = first.tolist()  # rank of the pair that begins at a position, -1 for none
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[at])) + 1
        if len(at):
            for positions in np.split(at, cuts):
                queue.open(int(first[positions[0]]), positions.tolist())
        border = border.tobytes()
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol runs from its position to its end
        while queue:
            rank, bucket = queue.pop()
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: one of its symbols has grown or gone
                gone = end[i]
                end[i] = stop = end[gone]
                pair[gone] = -1
                r = least = None
                if not border[stop]:
                    before[stop] = i
                    r = rank_of(data[i : end[stop]])
                if r is None:
                    pair[i] = -1
                else:
                    pair[i] = least = r
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        queue.open(r, [i])
                if not border[i]:
                    ahead = before[i]
                    r = rank_of(data[ahead:stop])
                    if r is None:
                        pair[ahead] = -1
                    else:
                        pair[ahead] = r
                        if r in buckets:
                            buckets[r].append(ahead)
                        else:
                            queue.open(r, [ahead])
                        if least is None or r < least:
                            least = r
                if least is not None and least < rank:  # a lower rank has come up, so the rest of this one waits
                    if k + 1 < len(bucket):
                        queue.open(rank, bucket[k + 1 :])
                    break
        out, ranks = [], self.ranks
        for i, z in zip(starts.tolist(), (starts + lengths).tolist(), strict=True):
            ids = []
            while i < z:
                ids.append(ranks[data[i : end[i]]])
                i = end[i]
            out.append(ids)
        return out

    def numbers(self, text: str) -> np.ndarray:
        """The number of each pre-token among the known ones; new ones are numbered as they come."""
        find, number = self.find_plain if text.isascii() else self.find, self.known.__getitem__
        fresh = self.known.fresh
        before = len(fresh)
        if len(text) > self.LONG:
            out = np.fromiter((number(m[0]) for m in find.finditer(text)), dtype=np.int64)
        else:
            pieces = find.findall(text)
            out = np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces))
        if find is self.find_plain or before == len(fresh) or self.doubtful.isdisjoint("".join(fresh[before:])):
            return out
        while len(fresh) > before:  # plainly split pre-tokens with doubtful characters are never known
            del self.known[fresh.pop()]
        spans = (text[m.start() : m.end()] for m in find.finditer(text.translate(self.instead)))
        return np.fromiter((number(x if self.doubtful.isdisjoint(x) else MARK + x) for x in spans), dtype=np.int64)

    def encode_batch(self, texts: list[str | None]) -> Encoded:
        """Encodes whole texts; None counts as the empty text. Pre-tokens are told apart by themselves, not by a hash."""
        numbers = [self.numbers(t or "") for t in texts]
        merged = self.merge([piece.lstrip(MARK).encode() for piece in self.known.fresh])
        self.known.fresh.clear()
        counts = np.concatenate([self.counts, np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))])
        pool = np.concatenate([self.pool, np.fromiter((i for ids in merged for i in ids), dtype=np.uint32)])
        starts = np.cumsum(counts) - counts
        flat = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        ids = pool[flatten(counts[flat], starts[flat])]
        total = np.concatenate([[0], np.cumsum(counts[flat])])
        while len(self.known) > self.MOST_KNOWN:
            self.known.popitem()
        self.counts = counts[: len(self.known)]
        self.pool = pool[: int(self.counts.sum())]
        return Encoded(ids, total[np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int64)])

    def decoded_bytes(self, e: Encoded, tokens: int = 2**19) -> Iterator[bytes]:
        """The bytes that the ids of each text stand for; about so many tokens are laid out at once."""
        for i in range(len(e)):
            ids = e.of(i)
            parts = [ids[k : k + tokens] for k in range(0, len(ids), tokens)]
            yield b"".join(self.shown[flatten(self.shown_lengths[p], self.shown_starts[p])].tobytes() for p in parts)

    def decode(self, ids) -> bytes:
        """The bytes of ids; those outside the vocabulary are passed over."""
        return b"".join(self.token_bytes[i] for i in ids if 0 <= i < self.size)


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a file, once in each Python worker; Arrow gives freed memory back there."""
    pa.set_memory_pool(pa.system_memory_pool())
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every whole text; a null text has no ids (null), an empty one the empty list.

    Repeated rows stay repeated, null keys stay, other columns are left out; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            e = bpe.encode_batch(texts)
            ids = pa.array([None if t is None else e.of(i) for i, t in enumerate(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    source = docs.select(key, text)
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes) of ids as encode() returns them; null ids give null."""
    arrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for b in batches:
            held = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], [key, "bytes"])

    source = encoded.select(key, "ids")
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by commas and of the decoded bytes.

    A null text counts as empty; an empty text has no tokens and the digests of no bytes. Repeated rows and
    null identifiers stay as they are. One pass without a shuffle; memory is bounded by an Arrow batch.
    """
    arrow_batches(docs.sparkSession, "3m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for b in batches:
            e = bpe.encode_batch(b.column(1).to_pylist())
            shown = [hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, e.of(i).tolist()))).hexdigest() for i in range(len(e))]
            back = [hashlib.sha256(x).hexdigest() for x in bpe.decoded_bytes(e)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(e.bounds), pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_rank_queue(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    from strandlake.llm.vocabularies import BYTE_BPE_MULTI, BYTE_PATTERN

    return digests(table(spark, sf_dir, "documents"), ranks or BYTE_BPE_MULTI(), BYTE_PATTERN())
