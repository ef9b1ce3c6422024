"""Operator 3: exact top-k inner-product search with a ball tree in each shard.

A shard's tree halves its vectors until leaves are small; a node holds the centre and radius of its
ball. For query q no vector below a node scores more than ``q . centre + radius * |q|``. Nodes are
taken in order of this bound, for a block of queries together, and a query leaves a node once the
bound lies below its k-th best score. Trees are grown once and written. Each query is first searched
in one shard, then in some more, then in the rest; its k-th score so far goes with it to the next
shards, so most of their nodes are cut from the start.
"""

from __future__ import annotations

import heapq
import io
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stage, table

#: Most vectors of a shard and most queries of a block: what one task holds in memory.
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARD, LEAF = 65_536, 32_768, 2_048, 128
#: Vectors this long or longer stay out of the trees: their products may not be exact in doubles.
LARGE = 2.0**25
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of the vectors that are whole and finite. vec_id is the key: of several vectors under one, the least in array order counts."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The list column as rows; shorter vectors are filled up with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    wide = int(lengths.max(initial=0))
    out = np.zeros((len(column), wide), dtype=np.int64)
    out[np.arange(wide)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


class BallTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # centre, radius, first, last, left, right
        self.points = points
        if len(points):
            self._build(0, len(points), leaf)
        self.points = points[self.order]

    def arrays(self) -> dict[str, np.ndarray]:
        wide = self.points.shape[1]
        return {"points": self.points, "centres": np.array([n[0] for n in self.nodes]).reshape(-1, wide), "radii": np.array([n[1] for n in self.nodes]), "spans": np.array([n[2:] for n in self.nodes], dtype=np.int64).reshape(-1, 4)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> BallTree:
        """The tree that arrays() described; its vectors are in the order of the tree."""
        tree = cls.__new__(cls)
        tree.points, tree.order = arrays["points"], np.arange(len(arrays["points"]))
        tree.nodes = [(c, float(r), *span) for c, r, span in zip(arrays["centres"], arrays["radii"], arrays["spans"].tolist(), strict=True)]
        return tree

    def _build(self, first: int, last: int, leaf: int) -> int:
        own = self.points[self.order[first:last]]
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        at = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if last - first > leaf:
            pole = own[int(away.argmax())]
            other = own[int(((own - pole) ** 2).sum(axis=1).argmax())]
            half = (last - first) // 2
            self.order[first:last] = self.order[first:last][np.argpartition(own @ (other - pole), half)]
            left, right = self._build(first, first + half, leaf), self._build(first + half, last, leaf)
        self.nodes[at] = (centre, float(np.sqrt(away.max(initial=0.0))), first, last, left, right)
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), rows x k, of each query's best, filled up with -inf; scores below floor may be missing."""
        ids = ids[self.order]
        best = np.full((len(queries), k), -np.inf)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        norms = np.sqrt((queries**2).sum(axis=1))

        def bounds(node: int, who: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            return (queries[who] @ centre + radius * norms[who]) + 1e-9 * norms[who] * (np.sqrt((centre**2).sum()) + radius) + 0.5

        ticket, everyone = count(), np.arange(len(queries))
        queue = [(0.0, next(ticket), 0, everyone, bounds(0, everyone))] if len(ids) else []
        while queue:
            _, _, node, who, most = heapq.heappop(queue)
            who = who[most >= np.maximum(floor[who], best[who, -1])]
            if not len(who):
                continue
            _, _, first, last, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    most = bounds(child, who)
                    heapq.heappush(queue, (-float(most.max()), next(ticket), child, who, most))
                continue
            scores = queries[who] @ self.points[first:last].T
            scores[ids[first:last][None, :] == query_ids[who][:, None]] = -np.inf
            useful = (scores >= np.maximum(floor[who], best[who, -1])[:, None]).any(axis=1)
            who, scores = who[useful], scores[useful]
            all_scores = np.concatenate([best[who], scores], axis=1)
            all_ids = np.concatenate([best_ids[who], np.broadcast_to(ids[first:last], scores.shape)], axis=1)
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        return best, best_ids


def plain_search(ids: np.ndarray, points: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The same for few vectors or few queries that are very long: in whole numbers of 64 bits, in unbounded ones where those overflow. Scores beyond a long become its limits."""
    rows, found, scores = [], [], []
    longest = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) for x in (points, queries)]
    kind = np.int64 if longest[0] * longest[1] < 2.0**62 else object
    wide = points.astype(kind)
    for r, (q, own) in enumerate(zip(queries.astype(kind), query_ids, strict=True)):
        ranked = heapq.nsmallest(k, ((-int(s), int(i)) for s, i in zip(wide @ q, ids, strict=True) if i != own))
        rows += [r] * len(ranked)
        found += [i for _, i in ranked]
        scores += [max(-(2**63), min(2**63 - 1, -s)) for s, _ in ranked]
    return rows, found, scores


def fitted(x: np.ndarray, wide: int) -> np.ndarray:
    """x with so many columns; what is cut off would meet zeros."""
    return x[:, :wide] if x.shape[1] >= wide else np.pad(x, ((0, 0), (0, wide - x.shape[1])))


def grown(key: tuple, vectors: pa.Table) -> pa.Table:
    """shard, tree: the ball tree of one shard with its identifiers, and the vectors too long for it."""
    points, ids = matrix(vectors["v"]), vectors["vec_id"].to_numpy()
    big = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1)) >= LARGE
    tree = BallTree(points[~big].astype(np.float64))
    out = io.BytesIO()
    np.savez(out, ids=ids[~big][tree.order], big=points[big], big_ids=ids[big], **tree.arrays())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([out.getvalue()], pa.binary())})


def search_shard(trees: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Searches one shard for one block of queries: trees shard, tree; queries query_id, q, floor."""
    none = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
    if not trees.num_rows or not queries.num_rows:
        return none
    held = dict(np.load(io.BytesIO(trees["tree"][0].as_py())))
    asked = fitted(matrix(queries["q"]), held["points"].shape[1])
    query_ids, real = queries["query_id"].to_numpy(), asked.astype(np.float64)
    floor = queries["floor"].fill_null(-(2**62)).to_numpy().astype(np.float64)
    long = np.sqrt((real**2).sum(axis=1)) >= LARGE
    tree, some = BallTree.of(held), np.flatnonzero(~long)
    best, best_ids = tree.search(held["ids"], real[some], query_ids[some], floor[some], k)
    r, c = np.nonzero(np.isfinite(best) & (best >= floor[some][:, None]))
    parts = [pa.table({"query_id": query_ids[some][r], "vec_id": best_ids[r, c], "score": best[r, c].astype(np.int64)})]
    whole, whole_ids = np.concatenate([held["points"].astype(np.int64), held["big"]]), np.concatenate([held["ids"], held["big_ids"]])
    for who, ids, points in ((some, held["big_ids"], held["big"]), (np.flatnonzero(long), whole_ids, whole)):
        if len(who) and len(ids):
            rows, found, scores = plain_search(ids, points, asked[who], query_ids[who], k)
            parts.append(pa.table({"query_id": query_ids[who][rows], "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())}))
    return pa.concat_tables(parts)


def best_of(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    vectors and queries: vec_id long (each once), v array<long>. A vector with the query's own vec_id is no candidate.
    Vectors of different lengths meet as if the shorter had zeros behind; equal vectors, however many, are
    split by count, not by place. Shards and blocks have a fixed greatest size, so a task's memory is
    bounded; every block meets every shard, so trees are sent once for each block. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    n, asked = vectors.count(), queries.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_SHARD))
    blocks = max(1, -(-asked // block_rows))
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("long"))
    trees = stage(held.groupBy("shard").applyInArrow(grown, "shard long, tree binary"), "op3-trees", "none")
    trees = trees.withColumn("block", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, blocks - 1)))))
    place = {"home": F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)), "block": F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("long")}
    wanted = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), *(c.alias(n) for n, c in place.items()))

    def run(left, right):
        return search_shard(left, right, k)

    cuts = [0, 1, 1 + -(-(shards - 1) // 8), shards]  # home, an eighth of the others, the rest
    found = spark.createDataFrame([], FOUND)
    for first, last in zip(cuts, cuts[1:]):
        if first < last:
            floors = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "floor")
            now = wanted.join(floors, "query_id", "left").withColumn("ahead", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (first, last - 1)))))
            now = now.select(F.pmod(F.col("home") + F.col("ahead"), F.lit(shards)).cast("long").alias("shard"), "block", "query_id", "q", "floor")
            new = trees.groupBy("shard", "block").cogroup(now.groupBy("shard", "block")).applyInArrow(run, FOUND)
            found = stage(best_of(found.unionByName(new), k).select("query_id", "vec_id", "score"), "op3-found")
    return best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(integer_vectors(table(spark, sf_dir, "embeddings")), "op3-vectors")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


#: DuckDB SQL for the rows of op3_topk.
OP3_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 5
"""
