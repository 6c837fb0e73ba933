"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source whose target is f times its size gets floor(f) whole copies and, with
probability frac(f), one more. The fractions are rounded dependently: two open documents exchange
word mass, up or down at random, until one of them holds none or all of its words, so that each
source keeps its total exactly and each document keeps its probability. One open document is left
of every bucket; the buckets of a source combine in a tree of fixed fan-in, and the last open
document of a source is rounded alone. A source therefore misses its target by less than the size
of one document.

Random draws are hashes of document ids, so reruns agree whatever the partitioning.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own,
the last; repeated rows (same doc_id, source and size) are separate documents told apart by a
running number; very long texts count with all their words; ties are drawn by the seed; an empty table gives no rows; other
columns are ignored by :func:`plan` and kept by :func:`apply`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD_BREAK, documents, materialise

#: Sources by code point weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST = 3
#: Documents of a bucket on average, and open documents that meet in one node of the tree.
FAN_IN = 200


def word_count(text: Column) -> Column:
    """Words of whole texts. Only the ends of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    n = F.size(parts)
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((F.get(parts, n - 1) == "") & (n > 1)).cast("int")
    return (n - first - last).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add weight and target to one row per source (source, n, source_size).

    The shares are filled by weight to a common level; a source whose cap lies below its share
    stays at the cap. In order of cap per weight, the level is that of the first source which
    holds its share when all before it are capped; this is where resharing the excess ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    rows = sources.select("*", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(MOST))).alias("cap"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.select("*", level.alias("level"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    shared = F.min(fits).over(Window.partitionBy())["level"]
    return rows.select(
        "source", "n", "source_size", F.least(F.col("cap"), F.coalesce(shared * F.col("weight"), F.col("cap"))).alias("target")
    )


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _round_bucket(items: Column, salt: Column) -> Column:
    """Fold a bucket: struct of the settled documents and the one still open.

    An item holds ``mass`` words of its ``size``. Moving ``up`` from the next item to the open one,
    or ``down`` the other way, settles at least one of the two.
    """
    empty = F.lit(None).cast("array<struct<doc_id:bigint,dup:int,size:bigint,extra:int>>")

    def step(state: Column, item: Column) -> Column:
        opened = state["open"]
        up = F.least(opened["size"] - opened["mass"], item["mass"])
        down = F.least(opened["mass"], item["size"] - item["mass"])
        rise = _draw(salt, opened["h"], opened["dup"], item["h"], item["dup"]) * (up + down) < down
        return F.struct(state["settled"].alias("settled"), opened.alias("open"), item.alias("item"), up.alias("up"), down.alias("down"), rise.alias("rise"))

    def settle(s: Column) -> Column:
        opened, item, up, down, rise = s["open"], s["item"], s["up"], s["down"], s["rise"]
        opened_ends = F.when(rise, up == opened["size"] - opened["mass"]).otherwise(down == opened["mass"])
        move = F.when(rise, up).otherwise(-down)
        ended = F.when(opened_ends, opened).otherwise(item)
        left = F.when(opened_ends, item).otherwise(opened)
        mass = left["mass"] + F.when(opened_ends, -move).otherwise(move)
        extra = F.when(opened_ends, rise).otherwise(~rise).cast("int")
        one = F.struct(ended["doc_id"].alias("doc_id"), ended["dup"].alias("dup"), ended["size"].alias("size"), extra.alias("extra"))
        return F.struct(
            F.concat(s["settled"], F.array(one)).alias("settled"),
            F.struct(left["h"].alias("h"), left["doc_id"].alias("doc_id"), left["dup"].alias("dup"), left["size"].alias("size"), mass.alias("mass")).alias("open"),
        )

    def both(state: Column, item: Column) -> Column:
        # a one-element array binds the intermediate values once
        return F.get(F.transform(F.array(step(state, item)), settle), F.lit(0))

    start = F.struct(F.coalesce(empty, F.array().cast("array<struct<doc_id:bigint,dup:int,size:bigint,extra:int>>")).alias("settled"), F.get(items, F.lit(0)).alias("open"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, both)


def plan(docs: DataFrame, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, source, dup, size, source_size, target, copies, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    items = materialise(
        sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c"))
        .select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("dup")),
        "mixing-items",
    )
    sources = materialise(targets(items.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))), "mixing-sources")
    most = sources.agg(F.max("n")).first()[0] or 0

    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    told = items.withColumnRenamed("source", "item_source").join(sources, F.col("item_source").eqNullSafe(F.col("source"))).select(
        "doc_id", "source", "dup", "size", "n", "source_size", "target",
        F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("p"),
    )
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    constants = F.struct("source", "source_size", "target", "whole").alias("of")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    buckets = F.ceil(F.col("n") / F.lit(fan_in))
    level = told.filter(open_).select(
        constants,
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("dup")), buckets).alias("bucket"),
        F.struct(h.alias("h"), "doc_id", "dup", "size", (F.col("p") * F.col("size")).alias("mass")).alias("item"),
    )
    done = [told.filter(~open_).select(constants, "doc_id", "dup", "size", F.lit(0).alias("extra"))]
    nodes, depth = -(-most // fan_in), 0
    while True:
        folded = level.groupBy("of", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items")).select(
            "of", "bucket", _round_bucket(F.col("items"), F.lit(seed + 2 + depth)).alias("out")
        )
        folded = materialise(folded, f"mixing-level{depth}")
        done.append(folded.select("of", F.explode("out.settled").alias("d")).select("of", "d.*"))
        if nodes <= 1:
            break
        level = folded.select("of", F.floor(F.col("bucket") / fan_in).alias("bucket"), F.col("out.open").alias("item"))
        nodes, depth = -(-nodes // fan_in), depth + 1
    last = F.col("out.open")
    alone = (_draw(F.lit(seed + 1), last["h"], last["dup"]) * last["size"] < last["mass"]).cast("int")
    done.append(folded.select("of", last["doc_id"].alias("doc_id"), last["dup"].alias("dup"), last["size"].alias("size"), alone.alias("extra")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    copies = F.col("of.whole") + F.col("extra")
    return rows.select(
        "doc_id", "of.source", "dup", "size", "of.source_size", "of.target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`plan` takes it, with the input's columns."""
    key = ["__m_id", "__m_source", "__m_size"]
    decided = plan(docs, seed).groupBy(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2])).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dup", "copies"))), lambda x: x["copies"]).alias("__m_copies")
    )
    keyed = docs.select("*", F.col("doc_id").alias("__r_id"), F.col("source").alias("__r_source"), word_count(F.col("text")).alias("__r_size"))
    alike = Window.partitionBy("__r_id", "__r_source", "__r_size").orderBy(F.xxhash64("text"))
    rows = keyed.select("*", F.row_number().over(alike).alias("__r_dup"))
    matched = rows.join(decided, rows["__r_id"].eqNullSafe(decided[key[0]]) & rows["__r_source"].eqNullSafe(decided[key[1]]) & (rows["__r_size"] == decided[key[2]]))
    times = F.element_at("__m_copies", F.col("__r_dup"))
    kept = matched.select(*(F.col(f"`{c}`") for c in docs.columns), times.alias("__times")).filter("__times > 0")
    return kept.select("*", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")
