"""Operator 12: Merkle manifest of a data set, by exchange of subtrees between superblocks.

Every row is a leaf; the leaves of a source form a tree by runs of 16, the sources' roots form one more
tree. A superblock is a run of 4,096 leaves of one source, three levels of its tree. Superblocks are
reduced to their tops; the few outer nodes above are built level by level and each superblock is told
the runs on its way to the root. Leaves and these outer nodes are then cogrouped by superblock, where
local reduction, joining of proofs and folding of leaves are finished together. No source, however large, lies
in one group, and nothing but a count a range partition is gathered.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stage, table
from strandlake.sources.staging import free

#: Children of a node, and levels of a tree that a superblock holds.
FANOUT, LOCAL = 16, 3
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One row in so many, by crc32 of doc_id, is tampered with in the query.
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values, each as '-' if null, else as its length in bytes, ':' and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def numbered(leaves: DataFrame) -> DataFrame:
    """tree (rank of the source from 0), pos (in its source) and the other columns, by source, doc_id and leaf; nulls come first.

    Range partitions are numbered where they lie. A row a partition, which is all that is broadcast, tells
    how many sources lie ahead and how many rows of its first source lie in partitions before.
    """
    order = ["source", "doc_id", "leaf", "folded"]
    held = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    held = stage(held.withColumn("part", F.shiftright("row", 33)).withColumn("row", F.expr("row & ((1L << 33) - 1)")), "op12-rows")
    runs = held.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("row").alias("begin"))
    runs = stage(runs.withColumn("run", F.expr("row_number() over (partition by part order by begin) - 1")), "op12-runs")
    parts = runs.groupBy("part").agg(F.count("*").alias("runs"), F.min_by("source", "run").alias("first"), F.max_by("source", "run").alias("last"), F.max_by("n", "run").alias("n_last"))
    parts = parts.withColumn("goes_on", F.expr("coalesce(lag(last) over (order by part) <=> first and lag(true) over (order by part), false)"))
    parts = parts.withColumn("ahead", F.expr("sum(runs - cast(goes_on as int)) over (order by part) - runs")).withColumn("so_far", F.expr("sum(n_last) over (partition by last order by part)"))
    parts = parts.withColumn("carried", F.expr("case when goes_on then lag(so_far) over (order by part) else 0 end")).select("part", "ahead", "carried")
    told = runs.join(F.broadcast(parts), "part")  # one row a partition
    told = told.select("part", "source", "begin", (F.col("ahead") + F.col("run")).alias("tree"), F.expr("case when run = 0 then carried else 0 end - begin").alias("shift"))
    # rows join their run by its place in the partition, so that a large source is dealt as its partitions are
    found = held.join(told.drop("begin"), (held["part"] == told["part"]) & held["source"].eqNullSafe(told["source"]))
    return found.select("tree", (F.col("row") + F.col("shift")).alias("pos"), held["doc_id"], "leaf", "folded")


def reduced(hashes: list[str], levels: int | None) -> list[list[str]]:
    """The levels above a run of nodes, the nodes first: as many as asked for, or until one is left."""
    out = [hashes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([joined(out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def local_levels(block: int, n: int) -> int | None:
    """A source's first superblock, if not full, is its whole tree and ends with one node; any other has all its levels."""
    return None if block == 0 and n < FANOUT**LOCAL else LOCAL


def tops(rows: DataFrame) -> DataFrame:
    """tree, idx, hash: the top of each superblock. rows: tree, pos, leaf."""

    def reduce(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        hashes = frame.sort_values("pos")["leaf"].tolist()
        return pd.DataFrame({"tree": [tree], "idx": [block], "hash": [reduced(hashes, local_levels(block, len(hashes)))[-1][0]]})

    held = rows.select("tree", F.expr(f"pos div {FANOUT**LOCAL}").alias("block"), "pos", "leaf")
    return held.groupBy("tree", "block").applyInPandas(reduce, "tree long, idx long, hash string")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The runs of each level of all trees, staged: tree, up, members (at most 16 hashes in order), done, hash of the run.

    nodes: tree, idx (from 0 without gaps), hash. A tree is done when one node is left: its run has that node alone.
    """
    levels = []
    while True:
        runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("members"))
        runs = runs.select("tree", "up", F.transform("members", lambda m: m["hash"]).alias("members"))
        runs = runs.withColumn("done", (F.col("up") == 0) & (F.size("members") == 1)).withColumn("hash", F.sha2(F.array_join("members", "").cast("binary"), 256))
        levels.append(stage(runs, "op12-level"))
        nodes = levels[-1].where("not done").select("tree", F.col("up").alias("idx"), "hash")
        if nodes.isEmpty():
            return levels


def single(levels: list[DataFrame]) -> DataFrame:
    """tree, hash: the one node that each tree ends with."""
    out = None
    for runs in levels:
        held = runs.where("done").select("tree", F.col("members")[0].alias("hash"))
        out = held if out is None else out.unionByName(held)
    return out


def descend(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """tree, idx, path, subroot, root of the nodes below all levels: path has, from the node up, its place in each run and the run. ends: tree, path, subroot, root."""
    paths = None
    for runs in reversed(levels):
        last = runs.where("done").select("tree").join(ends, "tree").select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
        if paths is not None:
            open_ = runs.where("not done").select("tree", "up", "members").join(paths.withColumnRenamed("idx", "up"), ["tree", "up"])
            open_ = open_.select("tree", "up", "members", "path", "subroot", "root", F.posexplode("members").alias("at", "h"))
            step = F.array(F.struct(F.col("at").cast("int").alias("at"), F.col("members").alias("run")))
            last = last.unionByName(open_.select("tree", (F.col("up") * FANOUT + F.col("at")).alias("idx"), F.concat(step, "path").alias("path"), "subroot", "root"))
        paths = last
    return paths


def finish(rows: DataFrame, outer: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf, superblock by superblock. outer: as descend() returns it."""

    def block_of(key: tuple, leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        _, block = key
        leaves = leaves.sort_values("pos")
        told = above.iloc[0]
        steps = [(int(s["at"]), list(s["run"])) for s in told["path"]]
        levels = reduced(leaves["leaf"].tolist(), local_levels(block, len(leaves)))
        outer_siblings = "".join("".join(run[:at] + run[at + 1 :]) for at, run in steps)
        proofs, folded = [], []
        for i, (own, changed) in enumerate(zip(levels[0], leaves["folded"].tolist(), strict=True)):
            siblings, h, place = [], changed if changed is not None else own, i
            for level in levels[:-1]:
                begin = place - place % FANOUT
                left, right = "".join(level[begin:place]), "".join(level[place + 1 : begin + FANOUT])
                siblings += [left, right]
                h, place = hashlib.sha256((left + h + right).encode()).hexdigest(), place // FANOUT
            for at, run in steps:
                h = joined(run[:at] + [h] + run[at + 1 :])
            proofs.append(hashlib.sha256(("".join(siblings) + outer_siblings).encode()).hexdigest())
            folded.append(h)
        out = pd.DataFrame({"doc_id": leaves["doc_id"].tolist(), "leaf": levels[0], "subroot": told["subroot"], "root": told["root"], "proof_sha256": proofs, "folded_root": folded})
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["verified"] = out["folded_root"] == out["root"]
        return out

    left = rows.withColumn("block", F.expr(f"pos div {FANOUT**LOCAL}")).groupBy("tree", "block")
    right = outer.withColumnRenamed("idx", "block").groupBy("tree", "block")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return left.cogroup(right).applyInPandas(block_of, schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """The root over all leaves and each leaf's proof, checked by folding. leaves: source, doc_id, leaf, folded (the hash to fold instead, or null).

    Leaves of a source ascend by doc_id, a null one first, then by leaf, so rows that share a doc_id have
    a place too and repeated rows are leaves of their own. A null source comes before the empty one. An
    empty table gives no rows.
    """
    leaves = stage(leaves.select("source", "doc_id", "leaf", "folded"), "op12-hashes")  # ranges are sampled first: texts are hashed once
    rows = stage(numbered(leaves), "op12-leaves")
    if rows.isEmpty():
        return finish(rows, _no_paths(rows))
    trees = climb(stage(tops(rows), "op12-tops"))
    subroots = stage(single(trees), "op12-subroots")
    over = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash"))
    none = F.expr("cast(array() as array<struct<at: int, run: array<string>>>)").alias("path")
    top = single(over).select("tree", none, F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    ends = descend(over, top).select(F.col("idx").alias("tree"), "path", "root").join(subroots.withColumnRenamed("hash", "subroot"), "tree")
    outer = stage(descend(trees, stage(ends, "op12-ends")), "op12-paths")
    free(*trees, *over, subroots)
    return finish(rows, outer)


def _no_paths(rows: DataFrame) -> DataFrame:
    return rows.select("tree", F.col("pos").alias("idx"), F.expr("cast(array() as array<struct<at: int, run: array<string>>>)").alias("path"), F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(f) for f in FIELDS]
    tampered = [*fields[:-1], F.translate("text", UPPER, LOWER)]
    wrong = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return manifest(docs.select("source", "doc_id", leaf_hash(fields).alias("leaf"), F.when(wrong, leaf_hash(tampered)).alias("folded")))


def op12_sql(levels: int = 8) -> str:
    """DuckDB SQL for the rows of op12_manifest, for sources and numbers of sources of up to 16 ** levels."""

    def value(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    own = " || ".join(value(c) for c in FIELDS)
    changed = own.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{LOWER}')::VARCHAR")
    # level l has, of each tree, its nodes; a tree of one node stays as it is
    ctes, step = [], f"""{{n}} AS MATERIALIZED (SELECT tree, CASE WHEN many THEN idx // {FANOUT} ELSE idx END AS idx, CASE WHEN any_value(many) THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h,
CASE WHEN any_value(many) THEN list(h ORDER BY idx) END AS run FROM (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many FROM {{b}}) GROUP BY 1, CASE WHEN many THEN idx // {FANOUT} ELSE idx END)"""
    ctes.append("s0 AS MATERIALIZED (SELECT tree, pos AS idx, leaf AS h FROM r)")
    ctes += [step.format(n=f"s{k + 1}", b=f"s{k}") for k in range(levels)]
    ctes.append(f"t0 AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, h FROM s{levels})")
    ctes += [step.format(n=f"t{k + 1}", b=f"t{k}") for k in range(levels)]
    walk = "SELECT doc_id, leaf, tree, pos, pos AS idx, coalesce(changed, leaf) AS h, '' AS p FROM r"
    for kind, key in (("s", "w.tree"), ("t", "0")):
        for k in range(1, levels + 1):
            name = f"w_{kind}{k}"
            at = f"(w.idx % {FANOUT})::INTEGER"
            ctes.append(f"""{name} AS (SELECT w.doc_id, w.leaf, w.tree, w.pos, CASE WHEN run IS NULL THEN w.idx ELSE w.idx // {FANOUT} END AS idx,
CASE WHEN run IS NULL THEN w.h ELSE sha256(array_to_string(run[1:{at}], '') || w.h || array_to_string(run[{at} + 2:], '')) END AS h,
CASE WHEN run IS NULL THEN w.p ELSE w.p || array_to_string(run[1:{at}], '') || array_to_string(run[{at} + 2:], '') END AS p
FROM ({walk}) w JOIN {kind}{k} n ON n.tree = {key} AND n.idx = CASE WHEN n.run IS NULL THEN w.idx ELSE w.idx // {FANOUT} END)""")
            walk = f"SELECT * FROM {name}"
        if kind == "s":
            ctes.append(f"w_root AS (SELECT w.doc_id, w.leaf, w.tree, w.pos, w.tree AS idx, w.h, w.p FROM w_s{levels} w)")
            walk = "SELECT * FROM w_root"
    return f"""WITH RECURSIVE bits AS (SELECT b, b AS v, 0 AS i FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM bits WHERE i < 8),
crcs AS (SELECT doc_id, doc_id::VARCHAR AS x, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id, x, crcs.i + 1, xor(c // 256, bits.v) FROM crcs JOIN bits ON bits.i = 8 AND bits.b = xor(c % 256, ascii(x[crcs.i + 1])) WHERE crcs.i < length(x)),
wrong AS (SELECT doc_id FROM crcs WHERE i = length(x) AND xor(c, 4294967295) % {TAMPER} = 0),
l AS (SELECT doc_id, source, sha256({own}) AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM wrong) THEN sha256({changed}) END AS changed FROM documents),
r AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
{", ".join(ctes)}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(w.p) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM w_t{levels} w JOIN s{levels} s ON s.tree = w.tree CROSS JOIN t{levels} t"""


OP12_SQL = op12_sql(4)
