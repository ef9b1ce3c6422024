"""Joins that move little: filters of members, frequent keys apart, rows to leave out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.staging import staged

#: A key with more than one in so many rows is dealt apart; there are at most so many of them, so they can be broadcast.
HOT = 2_000
#: Bits of the largest filter (8 MB, what a task gets of it), and places of a value in it.
FILTER_BITS, PLACES = 2**26, 4


def probable(keys: DataFrame, rows: int) -> Callable[[Column], Column]:
    """A test whether a value may be among the rows of a staged one-column table: a Bloom filter of built-in functions.

    Values that are there always pass; of others few do while rows stay below some millions, more
    beyond, as the filter has FILTER_BITS at most. So what it lets through is still to be joined.
    """
    bits = min(FILTER_BITS, max(2**10, 1 << (12 * max(1, rows) - 1).bit_length()))

    def places(value: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) for i in range(PLACES)]

    at = keys.select(F.explode(F.array(*places(F.col(keys.columns[0])))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    held = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("b")))).alias("w"))  # FILTER_BITS / 64 numbers at most
    filter_ = staged(held.select(F.transform("w", lambda x: x["b"]).alias("w")), "filter").scalar()

    def test(value: Column) -> Column:
        out = F.lit(True)
        for p in places(value):
            out = out & (F.call_function("shiftright", F.get(filter_, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    return test


def join_hot(rows: DataFrame, told: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a staged table of one row a key, which says in size how many of all total rows have the key.

    Keys of more than total / HOT rows, at most HOT of them, are broadcast; rows of the others are dealt by key.
    """
    hot = F.broadcast(told.where(F.col(size) * HOT > total))  # at most HOT rows
    others = rows.join(hot.select(key), key, "left_anti").join(told.where(F.col(size) * HOT <= total), key, how)
    return rows.join(hot, key).unionByName(others)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in the staged one-column table gone, null keys too.

    Rows that a filter doesn't find among gone stay where they are; only the others are dealt by key.
    """
    id_ = F.col(key).cast(gone.schema[0].dataType)
    maybe = probable(gone, gone.count())(id_)
    name = "gone" + "_" * max(map(len, docs.columns))  # no column of docs
    told = gone.distinct().toDF(name)
    return docs.where(~maybe).unionByName(docs.where(maybe).join(told, id_.eqNullSafe(F.col(name)), "left_anti"))
