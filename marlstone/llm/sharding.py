"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..N-1 in key order (ties by size and checksum; rows equal in all three are
interchangeable), whatever their partitioning. A balanced Feistel network over the smallest even
number of bits that holds N permutes the numbers; a value outside 0..N-1 is fed through again
until it falls inside (cycle walking), so the result is a permutation of 0..N-1. Position p goes
to shard p mod ``shards`` and slot p div ``shards``: the counts of two shards differ by one at
most (law ``rows``), slots have no gaps, and place and row number can be computed from each other
without a table. The key is read from ``seed``; equal texts are not kept together.

For the row numbers, rows are dealt into ranges of the key and its ties (Spark samples the ranges;
about ``RANGE_ROWS`` rows each, so a key on very many rows is cut as well), sorted and counted
within each, and written with their place in the range; the counts give each range's first number. The
ranges decide only how work is spread; the numbers follow from the order alone. Keys are of any
type that can be ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import words as W
from marlstone.session import cut

SHARDS = 8
SEED = 20240229
ROUNDS = 6
RANGE_ROWS = 1 << 14


def keys(seed: int, rounds: int = ROUNDS) -> np.ndarray:
    return W.mix(np.arange(1, rounds + 1, dtype=np.uint64) + W.mix(np.array([seed], np.uint64)))


def half_bits(n: int) -> int:
    """Bits of one half of the network's block."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Positions of row numbers 0..n-1, or with back the row numbers of positions."""
    half, ks = np.uint64(half_bits(n)), keys(seed)
    low = np.uint64((1 << int(half)) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & low
        for k in ks[::-1] if back else ks:
            if back:
                left, right = right ^ (W.mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (W.mix(right ^ k) & low)
        out[todo] = v = left << half | right
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def _permuter(seed: int):
    def f(row: pa.Array, n: pa.Array) -> pa.Array:
        if not len(row):
            return pa.array([], pa.int64())
        return pa.array(permute(row.to_numpy(zero_copy_only=False), n[0].as_py(), seed))

    return f


def _places(name: str):
    """Arrow batches of one range, in order, with each row's place in it."""

    def place(batches):
        n = 0
        for b in batches:
            yield b.append_column(name, pa.array(np.arange(n, n + b.num_rows)))
            n += b.num_rows

    return place


def numbered(docs: DataFrame, key: str, ties: list[Column], name: str = "__row", total: str = "__rows", range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with global row numbers by key (null first, then ties) and the number of rows.

    One pass samples the ranges, one shuffles the rows and writes them with their places. Rows
    equal in key and ties are interchangeable.
    """
    n = docs.count()
    order = [F.col(key).asc_nulls_first(), *ties]
    dealt = docs.repartitionByRange(max(1, -(-n // range_rows)), *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField(name, T.LongType())])
    placed = cut(dealt.mapInArrow(_places(name), schema), "numbered", keep=True)
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = cut(counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")), "ranges", keep=True)
    # 16 bytes a range: a megabyte for a thousand million rows
    return placed.join(F.broadcast(first), "__range").withColumn(name, F.col(name) + F.col("__first")).withColumn(total, F.lit(n).cast("long")).drop("__range", "__first")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep) with __size, __crc, __position, __shard and __slot.

    A null text has size 1 (no bytes, plus one) and the checksum of no bytes. Null keys come
    first. Repeated rows get a place each. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumns({"__size": size, "__crc": crc})
    if keep is not None:
        rows = rows.select(*keep, "__size", "__crc")
    rows = numbered(rows, key, [F.col("__size"), F.col("__crc")])
    at = F.arrow_udf(_permuter(seed), "long")(F.col("__row"), F.col("__rows"))
    return (
        rows.withColumn("__position", at)
        .withColumn("__shard", (F.col("__position") % shards).cast("int"))
        .withColumn("__slot", F.floor(F.col("__position") / shards).cast("long"))
        .drop("__row", "__rows")
    )
