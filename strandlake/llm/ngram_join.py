"""Operator 6: Jaccard join of word n-gram sets, size-aware and heavy-light.

Equal sets become one node. Under the order of shingle hashes, two sets of Jaccard similarity J or
more share at least l shingles among the first ``n - ceil(J n) + l`` of each, l growing with n. A set
with too few of these shingles in common with any other set has no partner and leaves. For the
others, partners must share c shingles, an overlap join with known c, done by size:

* small sets list every subset of fixed size (two) of their rarest shingles and meet in equal subsets;
* large sets scan the inverted lists of their rarest shingles, and meet small sets just below the boundary there;
* the boundary is the size at which listing subsets and scanning lists cost least in sum;
* sets so small that they need share one shingle only use subsets of size one.

Every set has a bitmap of parities: bit i tells whether an odd number of its shingles hashes to i. Two
bitmaps differ in at most as many bits as the sets in shingles, so pairs whose bitmaps differ too much
are told apart without their sets; all others are compared in full.

Sets that meet are first compared with one hub of each meeting place, over a few rounds. What is then
connected need not be compared again; all other meetings are compared in full. So components are
exact, while a group of thousands of near copies is not expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import HOT, arrow_batches, join_hot, stage, table, without
from strandlake.llm.word_bpe import split_chunks
from strandlake.operators.components import connected_components
from strandlake.sources.staging import free, freed_shuffles

#: Fixed by the contract: words in a shingle, least similarity in per cent.
WORDS, PERCENT = 5, 75
#: Rows up to which the surviving documents' identifiers are broadcast (some 16 MB); beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
#: Rounds of comparing with hubs before all that is left, and hubs of a place from the second round on.
HUB_ROUNDS, HUBS = 3, 8
#: A shingle with no more rows is no hot key, however small the table.
FEW = 1_000
#: Words of 64 bits in a set's bitmap.
BITMAP = 16
BITS = [f"b{i}" for i in range(BITMAP)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of an Arrow column."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = LOWER[np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]]
    _, _, hashes, per_text = split_chunks(data, bounds - bounds[0])
    factor = np.uint64(0x9E3779B97F4A7C15)

    def chained(h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return np.zeros(0, dtype=np.uint64)
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(31))) * factor + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))

    full = chained(hashes, words)
    ends = np.cumsum(per_text).tolist()
    for end, n in zip(ends, per_text.tolist(), strict=True):
        if n >= words:
            yield np.unique(full[end - n : end - words + 1])
        else:
            yield chained(hashes[end - n : end], n) if n else np.zeros(0, dtype=np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """The node of a set: 64 bits of a digest over its shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def overlap(n: int, percent: int = PERCENT) -> int:
    """Least number of shingles that a set of n shares with any similar one."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """l of the prefix of a set of n."""
    return max(1, n // 8)


def paired(percent: int = PERCENT) -> int:
    """From this size on, two similar sets share two shingles of their prefixes; sets below 100 / percent times it also meet in single ones."""
    return 1600 // percent + 1


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and node of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), node_of(s)) for s in shingle_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, node long")


def prefixes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """h, node, n: the first shingles of every set in hash order; a set that a task has seen is not repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            held, nodes, sizes = [], [], []
            for s in shingle_sets(b.column(0)):
                if len(s) and (node := node_of(s)) not in done:
                    done.add(node)
                    n = len(s)
                    held.append(s[: min(n, n - overlap(n, percent) + extra(n))])
                    nodes.append(node)
                    sizes.append(n)
            if held:
                lengths = [len(s) for s in held]
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(np.array(nodes), lengths)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths))], ["h", "node", "n"]))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, node long, n int")


def sliced(batch: pa.RecordBatch, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as signed words."""
    odd = np.bincount((shingles >> np.uint64(20)) & np.uint64(64 * BITMAP - 1), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def whole_sets(docs: DataFrame) -> DataFrame:
    """node, size, all shingles and the bitmap of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(0)))
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            bits = np.array([parities(s) for s in sets], dtype=np.int64).reshape(len(sets), BITMAP)
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(bits[:, i]) for i in range(BITMAP))], ["node", "n", "shingles", *BITS])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "node long, n int, shingles array<long>, " + ", ".join(f"{b} long" for b in BITS))


def may_be_similar(percent: int = PERCENT) -> str:
    """SQL over n, b0 .. and n2, b0_2 ..: whether the bitmaps allow the overlap that similar sets have."""
    differ = " + ".join(f"bit_count({b} ^ {b}_2)" for b in BITS)
    return f"{differ} <= n + n2 - 2 * (({percent} * (n + n2) + {99 + percent}) div {100 + percent})"


def least_shared(n="n", percent: int = PERCENT):
    """c of a set of n: l of the smallest partner that can be similar, as a column."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.col(n) * percent / 100) / 8)).cast("int")


def frequent(prefix: DataFrame) -> list[int]:
    """All shingles with more than one in HOT of the rows, and few others: a sketch of bounded size finds them."""
    told = prefix.agg(F.expr(f"approx_top_k(h, {2 * HOT}, {4 * HOT})").alias("top"), F.count("*").alias("n")).first()
    return [x.item for x in told.top or [] if x["count"] > max(FEW, told.n / HOT)]


def shared_prefixes(prefix: DataFrame, percent: int = PERCENT) -> DataFrame:
    """h, node, n, df: the prefix shingles that more than one set has, of sets that have c of them; twice, as sets that leave make others' shingles unique.

    Shingles are dealt by themselves and counted where they lie; the sets of frequent ones, a bounded list, are
    spread over all tasks instead, and their counts are broadcast.
    """
    prefix = stage(prefix, "op6-prefixes")
    hot = frequent(prefix)
    rows = prefix.where(~F.col("h").isin(hot)).repartition("h").groupBy("h", "node").agg(F.first("n").alias("n"))
    rows = rows.withColumn("df", F.expr("count(*) over (partition by h)")).where("df > 1")
    if hot:
        spread = prefix.where(F.col("h").isin(hot)).groupBy("h", "node").agg(F.first("n").alias("n"))
        counts = spread.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        rows = rows.unionByName(spread.join(F.broadcast(counts), "h"))  # a row for each frequent shingle
    rows, before = stage(rows, "op6-shared"), prefix
    for _ in range(2):
        enough = rows.groupBy("node").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= least_shared(percent=percent)).select("node")
        left = stage(rows.select("h", "node", "n").join(stage(enough, "op6-enough"), "node", "left_semi"), "op6-left")
        counts = stage(left.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "op6-df")
        free(before, rows)
        rows = stage(left.join(counts, "h").select("h", "node", "n", "df"), "op6-shared")
        free(left, counts)
        before = rows
    return rows


def choose_boundary(sets: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which subsets are listed: where listing below and scanning above cost least in sum.

    A list of df sets costs each of them its row and, as hubs halve what is left to compare, log2 df.
    sets: n, subsets, scanned. Sizes fall into eighths of powers of two, so the histogram is bounded.
    """
    bins = sets.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.max("n").alias("top"), F.sum("subsets").cast("double").alias("s"), F.sum("scanned").cast("double").alias("l")).orderBy("bin").collect()
    best, at = sum(b.l for b in bins), 0
    for i, b in enumerate(bins):
        cost = sum(x.s for x in bins[: i + 1]) + sum(x.l for x in bins if 100 * x.top > percent * b.top)
        if cost < best:
            best, at = cost, b.top
    return at


def meetings(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """place, node, n: where sets meet. Two similar sets have a place in common."""
    c, least = least_shared(percent=percent), paired(percent)
    sets = shared.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("rare")).withColumn("c", c)
    sets = sets.where(F.size("rare") >= F.col("c")).select("node", "n", F.expr("slice(rare, 1, size(rare) - c + 1)").alias("one"), F.expr("slice(rare, 1, least(size(rare), size(rare) - c + 2))").alias("two"))
    sets = stage(sets, "op6-rare")
    m = F.size("two").cast("long")
    costs = sets.where(F.col("n") >= least).select("n", (m * (m - 1) / 2).alias("subsets"), F.expr("aggregate(one, 0D, (t, x) -> t + 1 + log2(x.df))").alias("scanned"))
    boundary = choose_boundary(costs, percent)
    light = sets.where(F.col("n").between(least, boundary)).selectExpr("node", "n", "two", "explode(sequence(0, size(two) - 2)) as i", ).where("size(two) > 1")
    light = light.selectExpr("node", "n", "two[i].h as h", "explode(slice(two, i + 2, size(two))) as other").selectExpr("xxhash64('pair', h, other.h) as place", "node", "n")
    heavy = sets.where(100 * F.col("n") > percent * F.lit(max(boundary, least - 1))).selectExpr("node", "n", "explode(one) as x").selectExpr("xxhash64('list', x.h) as place", "node", "n")
    tiny = sets.where(percent * F.col("n") < 100 * least).selectExpr("node", "n", "explode(one) as x").selectExpr("xxhash64('one', x.h) as place", "node", "n")
    return light.unionByName(heavy).unionByName(tiny)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b whose whole sets are similar; bitmaps first."""
    first = sets.select(F.col("node").alias("a"), "n", *BITS)
    second = sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), *(F.col(b).alias(f"{b}_2") for b in BITS))
    near = pairs.join(first, "a").join(second, "b").where(may_be_similar(percent)).select("a", "b")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = near.join(left, "a").join(right, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def mixed_places(places: DataFrame) -> DataFrame:
    """place, node, n, root, node2, n2, root2: the places where several components meet, each row with the place's smallest set."""
    hubs = places.groupBy("place").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("n", "node", "root")).alias("hub"))
    hubs = stage(hubs.where("low <> high").selectExpr("place", "hub.node as node2", "hub.n as n2", "hub.root as root2"), "op6-hubs")
    return places.join(hubs, "place")


def strays(mixed: DataFrame, turn: int) -> DataFrame:
    """node, n, node2, n2: sets outside the component with most rows of a place, with some hubs of that component, other ones each turn."""
    counts = mixed.groupBy("place", "root").agg(F.count("*").alias("rows"))
    main = stage(counts.groupBy("place").agg(F.max(F.struct("rows", "root")).alias("m")).selectExpr("place", "m.root as main"), "op6-main")
    told = mixed.select("place", "node", "n", "root").join(main, "place")
    each = [F.min(F.struct(F.xxhash64(F.lit(turn * HUBS + i), "node"), "node", "n")) for i in range(HUBS)]
    hubs = stage(told.where("root = main").groupBy("place").agg(F.array_distinct(F.array(*[F.struct(h["node"].alias("node"), h["n"].alias("n")) for h in each])).alias("hubs")), "op6-hubs")
    return told.where("root <> main").join(hubs, "place").select("node", "n", F.explode("hubs").alias("h")).selectExpr("node", "n", "h.node as node2", "h.n as n2")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links a, b between nodes; node and root of the nodes that have some; described rows). The links' components are those of all similar pairs."""
    arrow_batches(docs.sparkSession, "2m")
    rows = stage(describe(docs), "op6-rows")
    shared = shared_prefixes(prefixes(docs, percent), percent)
    places = stage(meetings(shared, percent), "op6-places")
    free(shared)
    wanted = stage(places.select("node").distinct(), "op6-wanted")
    owners = stage(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "op6-owners")
    ids = owners.select(F.col("doc_id").alias("owner")).distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi")
    sets = stage(whole_sets(texts).join(owners.select("node"), "node", "left_semi").dropDuplicates(["node"]), "op6-sets")
    free(wanted, owners)
    similar_size = f"{percent} * greatest(n, n2) <= 100 * least(n, n2)"
    held, found, roots = places.withColumn("root", F.col("node")), None, None
    for k in range(HUB_ROUNDS + 1):
        mixed = stage(mixed_places(held), "op6-mixed")
        if k and mixed.isEmpty():
            break
        if k == 0 and HUB_ROUNDS:
            pairs = mixed.where(f"root <> root2 and {similar_size}")
        elif k < HUB_ROUNDS:
            pairs = strays(mixed, k).where(similar_size)
        else:
            drawn = stage(mixed.select("place", "node", "n", "root").join(sets.select("node", *BITS), "node"), "op6-drawn")
            other = drawn.selectExpr("place", "node as node2", "n as n2", "root as root2", *(f"{b} as {b}_2" for b in BITS))
            pairs = drawn.join(other, "place").where(f"node < node2 and root <> root2 and {similar_size} and {may_be_similar(percent)}")
        pairs = stage(pairs.selectExpr("least(node, node2) as a", "greatest(node, node2) as b").distinct(), "op6-pairs")
        new = stage(verified(pairs, sets, percent), "op6-links")
        found = new if found is None else found.unionByName(new)
        free(pairs, roots, places)
        roots = connected_components(found, "op6-roots")
        old, held = mixed, mixed.select("place", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if k < HUB_ROUNDS:
            held = stage(held, "op6-places")
            free(old)
            places = held
    free(sets)
    return found, roots, rows


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Texts without words, null ones too, have no shingles and are linked with nothing. Rows with equal
    sets are linked, repeated rows too; a null doc_id is never the smallest unless all are null. An
    empty table gives no rows.
    """
    with freed_shuffles(docs.sparkSession):
        _, roots, rows = links(docs, percent)
        filled = stage(rows.where("n_shingles > 0").join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root")), "op6-filled")
        least = stage(filled.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), "op6-least")
        linked = join_hot(filled, least, "root", "size", filled.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of a component, with all columns.

    Rows that share a doc_id stay or go together: they go if one of them lies in a component with a
    smaller doc_id. Nulls, empty texts and empty tables are treated as near_duplicates() says.
    """
    told = near_duplicates(docs)
    gone = stage(told.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct(), "op6-gone")
    return without(docs, gone)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
