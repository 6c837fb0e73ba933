"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connect(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node that it reaches.

    The large star hangs every larger neighbour of a node on the least of its neighbourhood, the
    small star does so for the smaller ones; the two alternate until every edge points to its
    component's least node. The number of rounds grows with the logarithm of the longest path, and
    nothing but one checksum per round reaches the driver.
    """
    current = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "edges")
        discard(current)
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large)
    own = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select("node", F.col("node").alias("component")))
