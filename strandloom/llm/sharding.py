"""Sharding along a Hilbert curve: quantised metadata dimensions, order by curve index, cut runs.

Neighbours on the curve are close in every dimension, so a shard file covers a small box of
(size, language, source) and its column statistics prune reads on any of them.

The law is ``rows``: shard s holds the global ranks from ceil(s * N / shards) on, so counts differ
by one at most. Equal texts of equal metadata are adjacent in the order.

Defined results: a null text has no bytes, its CRC is 0; null metadata quantise to 0; repeated rows
take separate slots; very long texts count with all their bytes; ties of curve and text are ordered by doc_id and size; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import documents, materialise

SHARDS = 40
#: Bits of each dimension.
BITS = 5
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transform)."""
    x = [np.asarray(a, dtype=np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(inside, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ flip) >> bit) & 1)
    return index


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], BITS))


def _label(column: str) -> Column:
    """A categorical dimension, quantised by hash."""
    return F.pmod(F.coalesce(F.crc32(F.col(column)), F.lit(0)), F.lit(1 << BITS)).cast("int")


def ranked(docs: DataFrame, carried: Sequence[Column] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve, the global rank of each row in curve order, and the ``carried`` columns.

    The rank needs no single-task window: the rows are range-partitioned and sorted once, kept as a
    table, and each partition's first rank is the sum of the counts before it. The joined counts
    are one row per partition, which bounds what is broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    by_size = F.least(F.floor(F.log2(size.cast("double")) * 1.5), F.lit((1 << BITS) - 1)).cast("int")
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        by_size.alias("q_size"), _label("lang").alias("q_lang"), _label("source").alias("q_source"), *carried,
    )
    more = rows.columns[len(rows.columns) - len(carried) :]
    rows = rows.select("doc_id", "size", "text_crc32", "text_hash", _curve("q_size", "q_lang", "q_source").alias("curve"), *more)
    order = ["curve", "text_hash", "doc_id", "size"]
    placed = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("place")), "shard-order"
    )
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(everything).alias("total")
    )
    local = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), part == F.col("part")).select(
        "doc_id", "size", "text_crc32", "curve", (F.col("start") + local).alias("rank"), "total", *more
    )


def assign(docs: DataFrame, shards: int = SHARDS, carried: Sequence[Column] = ()) -> DataFrame:
    """Add shard and slot by cutting the order into runs of equal counts."""
    rows = ranked(docs, carried)
    more = rows.columns[len(rows.columns) - len(carried) :]
    rows = rows.select("*", F.expr(f"cast(rank * {shards} div total as int)").alias("shard"))
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - first).alias("slot"), *more)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as one sorted run per shard: every row once, also of a null or repeated doc_id."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot"))).alias("document")
    assign(docs, shards, [whole]).select("document.*", "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions(
        "shard", "slot"
    ).write.partitionBy("shard").parquet(path)


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
