"""Unbranched paths of a packed graph, put together where nodes meet.

Edges are dealt by the minimiser of their nodes, so a task has all edges of the nodes dealt to it and joins those
that run through an unbranched one; consecutive nodes mostly share their minimiser. What is left to
be joined over all tasks are these fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import packed
from strandlake.sources.staging import free, staged

#: Bases of a minimiser at most, edges of a partition and of a message on average.
MINIMISER, EDGES, MESSAGE = 7, 1 << 19, 1 << 19

FRAGMENT = "id long, first long, skip int, loop boolean, bases string, counts array<long>"
MEASURED = "head long, at long, last long, length long, total long, squares double, low long, high long, first_count long, last_count long, least long, bases string"


def _minimiser(nodes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the word of a node, on either strand, whose hash is least: the same for a node and its other strand."""
    m = min(MINIMISER, k)
    best, back = None, packed.other_strand(nodes, k)
    for at in range(k - m + 1):
        word = np.minimum((nodes >> 2 * at) & (4**m - 1), (back >> 2 * (k - m - at)) & (4**m - 1)).astype(np.uint32)
        word = (word ^ (word >> np.uint32(7))) * np.uint32(0x9E3779B1)
        word = (word ^ (word >> np.uint32(15))) * np.uint32(0x85EBCA77)
        word ^= word >> np.uint32(13)
        best = word if best is None else np.minimum(best, word)
    best = (best ^ (best >> np.uint32(16))) * np.uint32(0xC2B2AE3D)  # least hashes are small: spread them
    return best ^ (best >> np.uint32(15))


def _messages(codes: np.ndarray, counts: np.ndarray, size: int, places: int) -> pa.RecordBatch:
    """A row a place: its edges, whether it has the source (1) and the target (2) of each."""
    source, target = (_minimiser(x, size - 1) % np.uint32(places) for x in (codes >> 2, codes & (4 ** (size - 1) - 1)))
    both = source == target
    place = np.concatenate((source, target[~both])).astype(np.int32)
    flags = np.concatenate((np.where(both, 3, 1), np.full((~both).sum(), 2))).astype(np.uint8)
    codes, counts = np.concatenate((codes, codes[~both])), np.concatenate((counts, counts[~both]))
    order = np.lexsort((codes, place))
    place, flags, codes, counts = place[order], flags[order], codes[order], counts[order]
    begins = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.append(begins[1:], len(place))
    kind = np.int32 if not len(counts) or counts.max() < 1 << 31 else np.int64
    # sorted numbers byte by byte, the first bytes of all together: that is what Spark's compression can use
    rows = [[x[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for a, b in zip(begins, ends, strict=True)] for x in (codes, counts.astype(kind), flags)]
    return pa.RecordBatch.from_arrays([pa.array(place[begins]), *(pa.array(r, pa.binary()) for r in rows), pa.array(np.full(len(begins), kind is np.int64))], ["place", "codes", "counts", "flags", "wide"])


def _numbers(message: bytes, kind: type) -> np.ndarray:
    """The numbers of a message's column."""
    return np.ascontiguousarray(np.frombuffer(message, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _joined(codes: np.ndarray, counts: np.ndarray, flags: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Fragments of the edges that a task has. skip: 1 if the first edge is the last one of another task's fragment."""
    mask = 4 ** (size - 1) - 1
    sides = []
    for rows, node in ((np.flatnonzero(flags & 1), codes >> 2), (np.flatnonzero(flags & 2), codes & mask)):
        node, rows = node[rows], rows.astype(np.int32)
        order = np.argsort(node, kind="stable").astype(np.int32)
        node = node[order]
        change = np.concatenate(([True], node[1:] != node[:-1], [True]))
        single = change[1:] & change[:-1]
        sides.append((node[single], rows[order[single]]))
    _, leaving, entering = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    jump = np.full(len(codes), -1, np.int32)
    jump[sides[0][1][leaving]] = sides[1][1][entering]
    del sides, node, order, change, single, leaving, entering
    rank, root = (jump >= 0).astype(np.int32), np.where(jump >= 0, jump, np.arange(len(codes), dtype=np.int32))
    active, before = np.flatnonzero(jump >= 0), -1
    while len(active) and len(active) != before:
        before, ahead = len(active), jump[active]
        more, far, top = rank[ahead], jump[ahead], root[ahead]
        rank[active] += more
        jump[active], root[active] = far, top
        active = active[far >= 0]
    loops, held = active, np.flatnonzero(jump < 0)
    if len(loops):
        one = pa.array(codes[loops])
        bases = pa.array(["ACGT"[c & 3] for c in codes[loops]])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(loops), pa.int64()), one, pa.array(np.zeros(len(loops), np.int32)), pa.array(np.ones(len(loops), bool)), bases, pa.array([[int(c)] for c in counts[loops]], pa.list_(pa.int64()))], names)
    held = held[np.lexsort((rank[held], root[held]))]
    begins = np.flatnonzero(rank[held] == 0)
    ends = np.append(begins[1:], len(held))
    for at in range(0, len(begins), 1 << 16):
        a, b = begins[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        rows = held[a[0] : b[-1]]
        offsets = np.append(a, b[-1]) - a[0]
        first, last = rows[offsets[:-1]], rows[offsets[1:] - 1]
        skip = (flags[first] & 1) == 0
        letters = np.frombuffer(b"ACGT", np.uint8)[codes[rows] & 3]
        offsets = pa.array(offsets.astype(np.int32))
        bases = pa.StringArray.from_buffers(len(a), offsets.buffers()[1], pa.py_buffer(letters))
        yield pa.RecordBatch.from_arrays([
            pa.array(codes[last] * 2 + ((flags[last] & 2) > 0)), pa.array(codes[first]), pa.array(skip.astype(np.int32)), pa.array(np.zeros(len(a), bool)), bases, pa.ListArray.from_arrays(offsets, pa.array(counts[rows])),
        ], names)


names = ["id", "first", "skip", "loop", "bases", "counts"]


def fragments(edges: DataFrame, size: int) -> DataFrame:
    """FRAGMENT, staged: id is twice the last edge, and one more if the path ends there or branches; with skip the first edge is the last one of the fragment before; loop: an edge of a cycle that one task has whole."""
    spark = edges.sparkSession
    codes = getattr(edges, "codes", None)
    rows = edges.count() if codes is None else 2 * codes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // EDGES)
    places, strings = 4 * parts, codes is None

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            if strings:
                flat, ends = packed.flattened(batch.column(0))
                if len(flat) != size * batch.num_rows or (flat > 3).any():
                    raise ValueError(f"edges must be {size} bases each")
                code = np.zeros(batch.num_rows, np.int64)
                for column in flat.reshape(-1, size).T:
                    code = code << 2 | column
                kept.append((code, batch.column(1).to_numpy()))
            else:
                code, count, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                kept.append((code, np.where(own, 2 * count, count)))  # the other strands' nodes go where these go
            n += len(kept[-1][0])
            if n >= MESSAGE:
                yield _messages(*(np.concatenate(x) for x in zip(*kept, strict=True)), size, places)
                kept, n = [], 0
        if n:
            yield _messages(*(np.concatenate(x) for x in zip(*kept, strict=True)), size, places)

    def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for c, n, f, wide in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                kept.append((_numbers(c, np.int64), _numbers(n, np.int64 if wide else np.int32), np.frombuffer(f, np.uint8)))
        if kept:
            c, n, f = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            if not strings:
                other = packed.other_strand(c, size)
                two = other != c
                c, n, f = np.concatenate((c, other[two])), np.concatenate((n, n[two])), np.concatenate((f, (f[two] & 1) << 1 | f[two] >> 1))
            yield from _joined(c, n.astype(np.int64), f, size)

    source = edges.select("edge", "count") if codes is None else codes.select("code", "n", "own")
    sent = source.mapInArrow(dealt, "place int, codes binary, counts binary, flags binary, wide boolean").repartition(parts, "place")
    return staged(sent.mapInArrow(compacted, FRAGMENT), "fragments")


def placed(found: DataFrame) -> tuple[DataFrame, bool]:
    """(id, head, pos of the last edge, of fragments on paths, by pointer doubling, staged; whether there are others, of cycles, whose head is null)."""
    jump = F.when(F.col("skip") > 0, F.col("first") * 2)
    # a fragment that has nothing but the last edge of the one before says nothing more
    state = staged(found.where(OWN).select("id", jump.alias("jump"), (F.length("bases") - 1).cast("long").alias("pos"), F.when(F.col("skip") == 0, F.col("first")).alias("head")), "state")
    before = None
    while (left := state.where("jump is not null").count()) and left != before:
        before = left
        # nothing runs on from a fragment whose path ends
        ahead = state.where("id % 2 = 0").select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("pos").alias("more"), F.col("head").alias("found"))
        moved = state.where("jump is not null").join(ahead, "jump").select("id", F.col("far").alias("jump"), (F.col("pos") + F.col("more")).alias("pos"), F.col("found").alias("head"))
        old, state = state, staged(state.where("jump is null").unionByName(moved), "state")
        free(old)
    return state, bool(left)


OWN = "not loop and length(bases) > skip"


def _codes_of(first: np.ndarray, skip: np.ndarray, bases: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the edges of pieces, where each piece begins): the source of the first edge and the last bases in one row, of which windows are taken."""
    letters, ends = packed.flattened(bases)
    lengths = np.diff(ends)
    # before the first base of the piece come the source's bases, or with skip all of the skipped edge's but the first
    context = np.where(skip > 0, first & (4 ** (size - 1) - 1), first >> 2)
    begins = ends[:-1] + (size - 1) * np.arange(len(lengths))
    whole = np.zeros(len(letters) + (size - 1) * len(lengths), np.uint8)
    for i in range(size - 1):
        whole[begins + i] = (context >> 2 * (size - 2 - i)) & 3
    own = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.arange(len(letters)) + (size - 1) * own  # where the window of each edge begins
    whole[starts + size - 1] = letters
    forward = packed.pack(whole, size)[0] if len(whole) >= size else np.empty(0, np.int64)
    return forward[starts].astype(np.int64), ends


def pieces(edges: DataFrame, size: int, by_edges) -> DataFrame:
    """head, at, first, skip, bases, counts, staged: runs of consecutive edges of an unbranched path; head is its first edge, at the place of the run's first one.

    first is the run's first edge, or with skip the one before. Edges of pure cycles, which no task can begin, are placed by by_edges
    (edges to edge, count, head, pos as strings).
    """
    found = fragments(edges, size)
    where, looped = placed(found)
    own = found.where(OWN).select("id", "first", "skip", F.expr("substring(bases, skip + 1)").alias("bases"), F.expr("slice(counts, skip + 1, size(counts) - skip)").alias("counts"))
    held = own.join(where.where("head is not null").select("id", "head", "pos"), "id").select("head", (F.col("pos") - F.length("bases") + 1).alias("at"), "first", "skip", "bases", "counts")
    out = staged(held, "pieces")
    rings = found.where("loop")
    if looped:
        rings = rings.unionByName(found.where(OWN).join(where.where("head is null").select("id"), "id", "left_semi"))
    rings = staged(rings, "rings")
    if not rings.isEmpty():
        ring = by_edges(staged(exploded_fragments(rings, size), "rings"))
        one = ring.select(packed.code_of("head").alias("head"), F.col("pos").alias("at"), packed.code_of("edge").alias("first"), F.lit(0).alias("skip"), F.expr("right(edge, 1)").alias("bases"), F.array("count").alias("counts"))
        out = staged(out.unionByName(one), "pieces")
    free(found, where)
    return out


def measured(held: DataFrame, size: int) -> DataFrame:
    """MEASURED of pieces: their last edge, sums of counts, and the least node that their edges touch."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, skip = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            codes, ends = _codes_of(first, skip, batch.column(4), size)
            count, a, last = batch.column(5).flatten().to_numpy(), ends[:-1], ends[1:] - 1
            least = np.minimum.reduceat(np.minimum(codes >> 2, codes & (4 ** (size - 1) - 1)), a)
            columns = [codes[last], np.diff(ends), np.add.reduceat(count, a), np.add.reduceat(count.astype(np.float64) ** 2, a), np.minimum.reduceat(count, a), np.maximum.reduceat(count, a), count[a], count[last], least]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), batch.column(4)], [x.split()[0] for x in MEASURED.split(", ")])

    return held.select("head", "at", "first", "skip", "bases", "counts").mapInArrow(told, MEASURED)


def exploded_fragments(found: DataFrame, size: int) -> DataFrame:
    """edge, count of fragments, each edge once."""

    def told(batches):
        for batch in batches:
            for first, skip, bases, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, codes = first, [first]
                for b in bases[1:]:
                    code = (code << 2 & (4**size - 1)) | "ACGT".index(b)
                    codes.append(code)
                yield pa.RecordBatch.from_arrays([packed.letters_of(np.array(codes[skip:], np.int64), size), pa.array(counts[skip:], pa.int64())], ["edge", "count"])

    return found.select("first", "skip", "bases", "counts").mapInArrow(told, "edge string, count long")


def exploded(held: DataFrame, size: int) -> DataFrame:
    """edge, count, head, pos of each edge of pieces."""

    def told(batches):
        for batch in batches:
            head, at, first, skip = (batch.column(i).to_numpy() for i in range(4))
            codes, ends = _codes_of(first, skip, batch.column(4), size)
            lengths = np.diff(ends)
            pos = np.arange(len(codes)) - np.repeat(ends[:-1] - at, lengths)
            yield pa.RecordBatch.from_arrays([packed.letters_of(codes, size), batch.column(5).flatten(), packed.letters_of(head, size).take(pa.array(np.repeat(np.arange(len(head)), lengths))), pa.array(pos)], ["edge", "count", "head", "pos"])

    # as in graph.from_codes(), no join may send this to every task for Spark's estimate
    return held.select("head", "at", "first", "skip", "bases", "counts").mapInArrow(told, "edge string, count long, head string, pos long").hint("merge")


def canonical_codes(held: DataFrame, size: int) -> DataFrame:
    """code, n, own of the edges of pieces that have both strands, as graph.from_codes() takes them."""

    def told(batches):
        for batch in batches:
            codes, _ = _codes_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), size)
            other, n = packed.other_strand(codes, size), batch.column(3).flatten().to_numpy()
            own, keep = codes == other, codes <= other
            yield pa.RecordBatch.from_arrays([pa.array(codes[keep]), pa.array(np.where(own, n // 2, n)[keep]), pa.array(own[keep])], ["code", "n", "own"])

    return held.select("first", "skip", "bases", "counts").mapInArrow(told, "code long, n long, own boolean")
