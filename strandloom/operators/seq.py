"""Operators on ordered sequences: any table with partition columns, a total order and a value.

All of them shuffle once on the partition columns; windows that share partition and order share
the sort. No operator names a domain column. A null value is no observation unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.stored import ready, stored, with_rows_of

Names = Sequence[str]


def _window(key: Names, order: Names):
    return Window.partitionBy(*key).orderBy(*order)


def number(df: DataFrame, key: Names, order: Names, name: str = "pos") -> DataFrame:
    """Positions from 0 in each sequence."""
    return df.withColumn(name, (F.row_number().over(_window(key, order)) - 1).cast("int"))


def slice_frames(df: DataFrame, index: str, first: int, last: int) -> DataFrame:
    """Rows first..last (both included), their index counted from 0 again."""
    return df.filter(F.col(index).between(first, last)).withColumn(index, F.col(index) - first)


def clamp_index(wanted: Column, n: Column) -> Column:
    """An index forced into 0..n-1."""
    return F.greatest(F.lit(0), F.least(wanted, n - 1))


def is_sample(pos: Column, n: Column, k: int) -> Column:
    """Whether a position is one of the at most k evenly spaced ones of 0..n-1, both ends included; only 0 if k or n is 1."""
    taken = F.least(F.lit(k), n)
    # a sample point is floor(j * (n - 1) / (taken - 1)) for some j; the least such j is a ceiling
    j = F.floor((pos * (taken - 1) + n - 2) / F.greatest(n - 1, F.lit(1)))
    hit = (j < taken) & (F.floor(j * (n - 1) / F.greatest(taken - 1, F.lit(1))) == pos)
    return (pos >= 0) & (pos < n) & F.when(taken <= 1, pos == 0).otherwise(hit)


def even_sample(df: DataFrame, key: Names, order: Names, k: int) -> DataFrame:
    """At most k rows of each sequence, evenly spaced with both ends; one row if k is 1."""
    placed = number(df, key, order).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    return placed.filter(is_sample(F.col("pos"), F.col("n"), k)).drop("n")


def page_wraps(df: DataFrame, key: Names, order: Names, x: str, drop: Column) -> DataFrame:
    """Boundaries: the first observation, and each that lies over ``drop`` left of the one before."""
    seen = df.filter(F.col(x).isNotNull())
    before = F.lag(x).over(_window(key, order))
    return seen.withColumn("before", before).filter(F.col("before").isNull() | (F.col(x) < F.col("before") - drop)).drop("before")


def page_groups(df: DataFrame, key: Names, order: Names, x: str, drop: Column) -> DataFrame:
    """Each row with its page, the page's size, and whether it contributes.

    Pages of more than two rows lose their first and last; if under three are left, all rows count (:func:`few_inside`).
    """
    w = _window(key, order)
    paged = df.withColumn("page", F.sum(F.when(F.lag(x).over(w).isNull() | (F.col(x) < F.lag(x).over(w) - drop), 1).otherwise(0)).over(w).cast("int"))
    page = Window.partitionBy(*key, "page")
    ranked = paged.withColumn("in_page", F.row_number().over(page.orderBy(*order))).withColumn("size", F.count("*").over(page))
    interior = (F.col("in_page") > 1) & (F.col("in_page") < F.col("size"))
    return ranked.withColumn("contributes", F.when(few_inside(F.col("size")), F.lit(True)).otherwise(interior))


def runs(df: DataFrame, key: Names, order: Names, flag: str) -> DataFrame:
    """Half-open runs [start, end) of true flags, by position."""
    placed = number(df, key, order).filter(flag)
    island = F.col("pos") - F.row_number().over(_window(key, ["pos"]))
    return placed.withColumn("island", island).groupBy(*key, "island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")
    ).drop("island")


def largest_run(df: DataFrame, key: Names, order: Names, flag: str) -> DataFrame:
    """The longest run of each sequence, the first of equals; sequences without one are absent."""
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("best")
    return runs(df, key, order, flag).groupBy(*key).agg(best).select(*key, "best.start", "best.end")


def close_short_gaps(df: DataFrame, key: Names, order: Names, flag: str, max_gap: int) -> DataFrame:
    """Fill false stretches of up to max_gap rows that lie strictly inside true ones."""
    w = Window.partitionBy(*key).orderBy("pos")
    last = F.max(F.when(F.col(flag), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col(flag), F.col("pos"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    short = F.coalesce(following - last - 1 <= max_gap, F.lit(False))
    return number(df, key, order).withColumn("closed", F.col(flag) | short)


def gap_clusters(df: DataFrame, key: Names, order: Names, value: str | Column, max_gap, name: str = "cluster") -> DataFrame:
    """Number the clusters from 1: a new one starts where the value jumps by more than max_gap."""
    value = F.col(value) if isinstance(value, str) else value
    w = _window(key, order)
    return df.withColumn("__v", value).withColumn("__new", F.coalesce((F.col("__v") - F.lag("__v").over(w) > max_gap).cast("int"), F.lit(1))).withColumn(
        name, F.sum("__new").over(w).cast("int")
    ).drop("__new", "__v")


def two_level_clusters(df: DataFrame, key: Names, value: str, near: float, far: float) -> DataFrame:
    """Values to lines (gap near), line centres by banker's rounding, lines to groups (gap far) from first to last centre."""
    lines = gap_clusters(df, key, [value], value, near, "line").groupBy(*key, "line").agg(F.bround(F.avg(value), 0).cast("long").alias("center"))
    grouped = gap_clusters(lines, key, ["center", "line"], "center", far, "staff")
    return grouped.groupBy(*key, "staff").agg(F.min("center").alias("top"), F.max("center").alias("bottom"), F.count("*").cast("int").alias("n_lines"), F.array_sort(F.collect_list("center")).alias("line_centers"))


def fraction_where(df: DataFrame, key: Names, condition: Column, name: str = "fraction") -> DataFrame:
    return df.groupBy(*key).agg(F.avg(condition.cast("int")).alias(name))


def median_box(df: DataFrame, key: Names, edges: Names) -> DataFrame:
    """Each edge's median by itself, rounded half to even."""
    return df.groupBy(*key).agg(*(F.bround(F.median(e), 0).alias(e) for e in edges))


def agreement(df: DataFrame, key: Names, edges: Names, side: str, tolerance: float = 0.03) -> DataFrame:
    """Share of all samples, boxes or null, whose every edge lies within tolerance * ``side`` of the unrounded median box.

    ``side`` is the larger side of what the boxes lie in, to three places by banker's rounding.
    """
    middle = df.groupBy(*key).agg(*(F.median(e).alias(f"box_{e}") for e in edges))
    near = F.lit(True)
    for e in edges:
        near = near & (F.abs(F.col(e) - F.col(f"box_{e}")) <= F.col(side) * tolerance)
    agreed = F.sum(F.coalesce(near, F.lit(False)).cast("int"))
    return df.join(middle, list(key)).groupBy(*key).agg(F.bround(agreed / F.count("*"), 3).alias("confidence"), F.count("*").alias("n"))


def modal_value(df: DataFrame, key: Names, order: Names, value: str) -> DataFrame:
    """The most frequent value; of equals the one seen first."""
    counted = number(df, key, order).groupBy(*key, value).agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    return counted.groupBy(*key).agg(F.max_by(value, F.struct("c", -F.col("first"))).alias(value), F.max("c").alias("votes"))


def anomalies(df: DataFrame, key: Names, value: str, sigmas: float = 3.0, least: float = 25.0) -> DataFrame:
    """Rows above median + max(sigmas * population deviation, least) of their sequence; the limits are joined."""
    limit = F.col("__median") + F.greatest(F.lit(sigmas) * (F.col("__spread") + 1e-6), F.lit(least))
    spread = df.groupBy(*key).agg(F.stddev_pop(value).alias("__spread"))
    limits = exact_median(df, key, value, "__median").join(spread, list(key)).select(*key, limit.alias("__limit"))
    return with_rows_of(df, limits, list(key), "left").withColumn("anomalous", F.col(value) > F.col("__limit")).drop("__limit")


def argmax_first(df: DataFrame, key: Names, position: str, value: str) -> DataFrame:
    """Position of the largest value, the lowest of equals; null where nothing is above zero."""
    best = F.max_by(F.struct(position, value), F.struct(value, -F.col(position))).alias("best")
    out = df.groupBy(*key).agg(best)
    return out.select(*key, F.when(F.col(f"best.{value}") > 0, F.col(f"best.{position}")).alias(position))


def few_inside(size: Column, least: int = 3) -> Column:
    """Whether a page has under ``least`` rows between its first and last (its only ones, if it has two at most)."""
    return F.when(size > 2, size - 2).otherwise(size) < least


def composite_level(value: str, few: Column) -> Column:
    """Aggregate of a pixel's values: the median, cut to a whole number, or on a page of ``few`` rows the largest."""
    return F.floor(F.when(F.max(few), F.max(value)).otherwise(F.median(value))).cast("double")


#: Rank error of the sketch that brackets a median is 1 / ACCURACY of the rows.
ACCURACY = 5000


def exact_median(df: DataFrame, key: Names, value: str, name: str = "median") -> DataFrame:
    """(key, median) of few keys with any number of rows: no task holds the rows of a key.

    A mergeable sketch gives two values between which the middle ranks must lie. Rows below are counted, values between are
    counted by value, and only these, a thousandth of a key's distinct values, are ranked. All three steps combine on the
    map side. Null values are left out; a key with nothing else has a null median.
    """
    near = [0.5 - 2.0 / ACCURACY, 0.5 + 2.0 / ACCURACY]
    ends = df.groupBy(*key).agg(F.percentile_approx(value, F.array(*map(F.lit, near)), F.lit(ACCURACY)).alias("__ends"), F.count(value).alias("__n"))
    ends = stored(ends.select(*key, F.get("__ends", F.lit(0)).alias("__low"), F.get("__ends", F.lit(1)).alias("__high"), "__n"), "brackets")
    rows = with_rows_of(df.select(*key, value), ends, list(key))
    below = F.col(value) < F.col("__low")
    place = F.when(below, F.lit(None)).otherwise(F.col(value))
    counted = rows.filter(F.col(value) <= F.col("__high")).groupBy(*key, "__n", place.alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*key).orderBy(F.col("__v").asc_nulls_first())
    ranked = counted.withColumn("__end", F.sum("__c").over(w))
    holds = lambda rank: F.max(F.when((F.col("__end") - F.col("__c") <= rank) & (rank < F.col("__end")), F.col("__v")))
    middle = ranked.groupBy(*key).agg(holds(F.expr("(__n - 1) div 2")).alias("__a"), holds(F.expr("__n div 2")).alias("__b"))
    lost = F.raise_error(F.lit("a middle rank lies outside its bracket")).cast("double")
    told = middle.select(*key, F.when(F.col("__a").isNull() | F.col("__b").isNull(), lost).otherwise((F.col("__a") + F.col("__b")) / 2).alias(name))
    return ends.select(*key).join(told, list(key), "left")


def mad_z(df: DataFrame, key: Names, value: str, name: str = "z") -> DataFrame:
    """Absolute robust z-score: |v - median| / (1.4826 * (MAD + 1e-6)); medians are joined, rows of a key stay spread."""
    off = with_rows_of(df, exact_median(df, key, value, "__median"), list(key), "left").withColumn("__off", F.abs(F.col(value) - F.col("__median"))).drop("__median")
    told = with_rows_of(off, exact_median(off, key, "__off", "__mad"), list(key), "left")
    return told.withColumn(name, F.col("__off") / (1.4826 * (F.col("__mad") + 1e-6))).drop("__off", "__mad")


def outlier_events(df: DataFrame, key: Names, position: str, z: str, limit: float, max_gap: int) -> DataFrame:
    """Outliers at most max_gap apart form an event at its strongest (the first of equals); it starts one later."""
    near = gap_clusters(df.filter(F.col(z) > limit), key, [position], position, max_gap, "event")
    peak = F.max_by(position, F.struct(z, -F.col(position)))
    return near.groupBy(*key, "event").agg((peak + 1).alias("start"), F.max(z).alias("peak"))


def adjacent_distance(df: DataFrame, key: Names, order: Names, vector: str) -> DataFrame:
    """Euclidean distance of each vector to the next of its sequence, in double precision."""
    w = _window(key, order)
    squares = F.zip_with(F.col(vector), F.lead(vector).over(w), lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2))
    return df.withColumn("distance", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def running_offsets(df: DataFrame, key: Names, order: Names, match: Column, confident: Column, shift: Column, limit: Column) -> DataFrame:
    """Cumulative offsets of pairs: a confident match counts if not negative, else a shift in [0, limit), else nothing."""
    fallback = (shift >= 0) & (shift < limit)
    kind = F.when(confident, "match").when(fallback, "fallback").otherwise("unresolved")
    step = F.when(confident, F.greatest(match, F.lit(0.0))).when(fallback, shift).otherwise(F.lit(0.0))
    w = _window(key, order)
    return df.withColumn("resolution", kind).withColumn("step", step).withColumn("offset", F.sum("step").over(w))


def advance_mode(df: DataFrame, key: Names, dx: str, dy: str, width: float | str, height: float | str, static: float = 2.0) -> DataFrame:
    """Kind of motion from adjacent displacements: the medians decide, else the coherence of larger events.

    ``width`` and ``height`` are those of what moves, numbers for all sequences or columns; an event covers 2 % of the side
    along its axis. Under four events tell nothing: their coherence is 0.
    """
    side = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    axis = F.when(F.col("sum_x") >= F.col("sum_y"), "x").otherwise("y")
    sums = df.groupBy(*key).agg(F.sum(F.abs(F.col(dx))).alias("sum_x"), F.sum(F.abs(F.col(dy))).alias("sum_y"), F.median(F.abs(F.col(dx))).alias("med_dx"), F.median(F.abs(F.col(dy))).alias("med_dy"))
    along = F.col("axis") == "x"
    moved = df.join(sums.withColumn("axis", axis), list(key)).withColumn("d", F.when(along, F.col(dx)).otherwise(F.col(dy)))
    big = F.abs(F.col("d")) > F.greatest(F.lit(2.0), 0.02 * F.when(along, side(width)).otherwise(side(height)))
    told = moved.groupBy(*key, "axis", "med_dx", "med_dy").agg(F.sum((big & (F.col("d") > 0)).cast("int")).alias("up"), F.sum((big & (F.col("d") < 0)).cast("int")).alias("down"))
    n = F.col("up") + F.col("down")
    told = told.withColumn("n_events", n).withColumn("coherence", F.when(n >= 4, F.round(F.greatest("up", "down") / n, 6)).otherwise(F.lit(0.0)))
    coherent = (F.col("n_events") >= 4) & (F.greatest("up", "down") * 100 >= F.col("n_events") * 85)
    mode = (
        F.when((F.col("med_dy") > static) & (F.col("med_dy") >= F.col("med_dx")), "scroll_vertical")
        .when((F.col("med_dx") > static) & (F.col("med_dx") > F.col("med_dy")), "scroll_horizontal")
        .when(coherent & (F.col("axis") == "y"), "scroll_vertical")
        .when(coherent, "scroll_horizontal")
        .otherwise("paginated")
    )
    return told.withColumn("mode", mode).select(*key, "mode", "axis", "n_events", "coherence", "med_dx", "med_dy")


def otsu(df: DataFrame, key: Names, value: str) -> DataFrame:
    """Threshold of largest between-class variance, as a bin centre; the maximum if all values are equal or single.

    Histograms have min(64, max(8, n)) bins. Only one row per bin leaves the first aggregation.
    """
    stats = df.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    stats = stats.withColumn("bins", F.least(F.lit(64), F.greatest(F.lit(8), F.col("n"))).cast("int"))
    flat = stats.filter((F.col("n") < 2) | (F.col("low") == F.col("high"))).select(*key, F.col("high").alias("threshold"))
    at = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")).cast("int"), F.col("bins") - 1)
    spread = df.join(stats.filter((F.col("n") >= 2) & (F.col("low") < F.col("high"))), list(key)).withColumn("bin", at)
    counts = spread.groupBy(*key, "low", "high", "bins", "n", "bin").agg(F.count("*").alias("c"))
    center = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / F.col("bins")
    w = Window.partitionBy(*key).orderBy("bin")
    running = counts.withColumn("center", center).withColumn("w0", F.sum("c").over(w)).withColumn("s0", F.sum(F.col("c") * F.col("center")).over(w))
    running = running.withColumn("s", F.sum(F.col("c") * F.col("center")).over(Window.partitionBy(*key)))
    w1 = F.col("n") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    scored = running.withColumn("between", F.coalesce(F.round(F.col("w0") * w1 * gap * gap / (F.col("n") * F.col("n")), 6), F.lit(0.0)))
    best = scored.groupBy(*key).agg(F.max_by("center", F.struct("between", -F.col("bin"))).alias("threshold"))
    return best.unionByName(flat)


def band_cover(frames: DataFrame, bands: DataFrame, length: int, band: int, least: int = 3) -> DataFrame:
    """Frames (f, off) that contribute to bands (b, y0, y1): those that contain it, or where fewer than ``least`` do, that touch it.

    The interval join becomes an equi-join: a frame is exploded to the fixed-height bands it touches. Containing frames are
    counted on the map side; the counts, one row a band, are joined, so that no task holds a band.
    """
    touched = F.sequence(F.expr(f"off div {band}"), F.expr(f"(off + {length} - 1) div {band}"))
    pairs = with_rows_of(frames.select("f", "off", F.explode(touched).alias("b")), bands, "b")
    pairs = pairs.filter(f"off < y1 AND off + {length} > y0").withColumn("inside", F.expr(f"off <= y0 AND off + {length} >= y1"))
    whole = pairs.groupBy("b").agg(F.sum(F.col("inside").cast("int")).alias("n_inside"))
    return with_rows_of(pairs, whole, "b").filter((F.col("n_inside") < least) | F.col("inside")).withColumn("fallback", F.col("n_inside") < least)


def placed(df: DataFrame, key: Names, order: Names, name: str = "pos") -> DataFrame:
    """Positions from 0 in each sequence, of any length: rows are sorted by ranges and stored, and a range's first position is
    the sum of the counts before it. Keys must not be null."""
    rows = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).select("*", F.monotonically_increasing_id().alias("__at"))
    rows = stored(rows, "order").withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy(*key, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__part")) - F.col("__n")
    parts = parts.select(*key, "__part", "__first", before.alias("__before"))
    return with_rows_of(rows, parts, [*key, "__part"]).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


#: Items of a sequence that one task packs.
PACKED = 50_000


def _starts(heights: np.ndarray, own: int, capacity: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``own`` items, the item that starts the sheet after one that it starts; and the height before each item."""
    steps = np.concatenate(([0], np.cumsum(heights + gap)))
    after = np.searchsorted(steps[:-1] + heights, steps[:own] + capacity, side="right")
    return np.maximum(after, np.arange(1, own + 1)), steps


def pack(df: DataFrame, key: Names, order: Names, height: str, capacity: int, gap: int) -> DataFrame:
    """Greedy packing in order: a band that does not fit under the ones above, with gaps, starts a new sheet.

    A band taller than the sheet is still placed, alone at its top. Heights are 1 at least.

    The start after each start is a jump function over positions. A sequence is cut to blocks of ``PACKED`` items, each with as many
    items of the next one as a sheet can hold. A block tells, for each place where the first sheet that starts in it may start,
    where the first one after it starts and how many sheets lie between; these few rows a block are followed from block to block,
    and then each block places its own items. So a task holds a block, whatever the length of a sequence.
    """
    reach = capacity // max(gap + 1, 1) + 2
    block = max(PACKED, reach + 1)
    ready(df.sparkSession)
    kinds = dict(df.dtypes)
    items = placed(df.select(*key, *order, F.col(height).cast("int").alias("__h")), key, order, "__pos")
    items = stored(items.withColumn("__block", F.expr(f"__pos div {block}")), "bands")
    ahead = items.filter(f"__block > 0 AND __pos % {block} < {reach}").withColumn("__block", F.col("__block") - 1)
    with_next = items.select(*key, "__block", "__pos", "__h").unionByName(ahead.select(*key, "__block", "__pos", "__h"))
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        b, heights = int(pdf["__block"].iloc[0]), pdf["__h"].to_numpy(np.int64)
        own = int((pdf["__pos"] < (b + 1) * block).sum())
        after, steps = _starts(heights, own, capacity, gap)
        # jumps compose by doubling; places beyond the block stay
        to = np.concatenate((after, np.arange(own, len(heights) + 2)))
        last, sheets = np.arange(len(to)), np.concatenate((np.ones(own, np.int64), np.zeros(len(to) - own, np.int64)))
        while (to[:own] < own).any():
            last = np.where(to < own, last[to], last)
            sheets, to = sheets + sheets[to], to[to]
        entries = np.arange(min(reach, own))
        out = pd.DataFrame({"entry": entries, "exit": to[entries] - own, "sheets": sheets[entries], "hang": steps[own] - steps[last[entries]]})
        return out.assign(__block=b, **{k: pdf[k].iloc[0] for k in key})[[*key, "__block", "entry", "exit", "sheets", "hang"]]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        told = {(r.block, r.entry): r for r in pdf.rename(columns={"__block": "block"}).itertuples(index=False)}
        entry, sheet, hang, out = 0, 0, 0, []
        for b in range(int(pdf["__block"].max()) + 1):
            out.append((b, entry, sheet, hang))
            here = told[b, entry]
            entry, sheet, hang = here.exit, sheet + here.sheets, here.hang
        out = pd.DataFrame(out, columns=["__block", "entry", "sheet", "hang"])
        return out.assign(**{k: pdf[k].iloc[0] for k in key})[[*key, "__block", "entry", "sheet", "hang"]]

    if items.filter("__block > 0").isEmpty():
        begins = items.select(*key).distinct().select(*key, F.lit(0).cast("long").alias("__block"), *(F.lit(0).cast("long").alias(c) for c in ("entry", "sheet", "hang")))
    else:
        told = with_next.groupBy(*key, "__block").applyInPandas(jumps, f"{keys}, __block long, entry long, exit long, sheets long, hang long")
        begins = told.groupBy(*key).applyInPandas(follow, f"{keys}, __block long, entry long, sheet long, hang long")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        heights, entry, sheet, hang = pdf["__h"].to_numpy(np.int64), *(int(pdf[c].iloc[0]) for c in ("entry", "sheet", "hang"))
        after, steps = _starts(heights, len(heights), capacity, gap)
        firsts, at = [], entry
        while at < len(heights):
            firsts.append(at)
            at = int(after[at])
        which = np.searchsorted(np.array(firsts, np.int64), np.arange(len(heights)), side="right") - 1
        top = np.where(which < 0, -hang, steps[np.array(firsts or [0])][which])
        return pdf.assign(sheet=sheet + which, y=steps[:-1] - top)[columns]

    columns = [*key, *order, "__h", "sheet", "y"]
    schema = f"{keys}, " + ", ".join(f"`{c}` {kinds[c]}" for c in order) + ", __h int, sheet int, y int"
    done = with_rows_of(items, begins, [*key, "__block"]).groupBy(*key, "__block").applyInPandas(place, schema)
    return done.withColumnRenamed("__h", height)


def recent(df: DataFrame, created: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(created).desc(), F.col(tie)).limit(n)


def last_rows(df: DataFrame, key: Names, order: Names, n: int) -> DataFrame:
    """The last n rows of each sequence."""
    back = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= n).drop("__back")


def first_match(left: DataFrame, right: DataFrame, on: Names, position: str) -> DataFrame:
    """Equi-lookup where the right row of least position wins."""
    best = right.withColumn("__rank", F.row_number().over(Window.partitionBy(*on).orderBy(position))).filter("__rank = 1").drop("__rank")
    return left.join(best, list(on), "left")


def upsert(base: DataFrame, changes: DataFrame, key: str, position: str) -> DataFrame:
    """Replace by key in place: rows keep their position, new keys follow; of several changes the last wins."""
    last = changes.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(position).desc()))).filter("__rank = 1").drop("__rank")
    old, new = base.alias("o"), last.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    columns = [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in base.columns if c != position]
    return joined.select(*columns, F.struct(F.col(f"o.{key}").isNull().alias("late"), F.coalesce(f"o.{position}", f"n.{position}").alias("at")).alias("place"))


def replace_to_end(base: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """Drop rows of the same key and append; callers order by what they keep."""
    return base.join(row, key, "left_anti").withColumn("appended", F.lit(False)).unionByName(row.withColumn("appended", F.lit(True)))


def best_first(df: DataFrame, key: Names, group: Names, order: Sequence[Column]) -> DataFrame:
    """The first row in ``order`` of each group of a key, with its ``rank`` from 0 among the key's; a null group is a group."""
    first = F.row_number().over(Window.partitionBy(*key, *group).orderBy(*order))
    kept = df.withColumn("__first", first).filter("__first = 1").drop("__first")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def next_start(df: DataFrame, key: Names, order: Names, start: str, last, name: str = "next") -> DataFrame:
    """Each boundary with the one after it; ``last`` for the last."""
    return df.withColumn(name, F.lead(start, 1, last).over(_window(key, order)))


def precedence(base: DataFrame, key: str, column: str, layers: Sequence[DataFrame], default: Column) -> DataFrame:
    """``column`` of the first layer (key, column) that has the key with a value, else the default."""
    out, names = base, []
    for i, layer in enumerate(layers):
        names.append(f"__layer_{i}")
        out = out.join(layer.select(key, F.col(column).alias(names[-1])), key, "left")
    return out.withColumn(column, F.coalesce(*names, default)).drop(*names)


def concat_ordered(rows: DataFrame, key: Names, part: str, order: Names, name: str = "ordinal") -> DataFrame:
    """Rows of a key's ordered parts numbered from 1 as one sequence; windows over whole keys see one row a part only."""
    sizes = rows.groupBy(*key, part).agg(F.count("*").alias("n"))
    sizes = sizes.select(*key, part, (F.sum("n").over(Window.partitionBy(*key).orderBy(part)) - F.col("n")).alias("__before"))
    placed = number(rows, [*key, part], order, "__pos").join(sizes, [*key, part])
    return placed.withColumn(name, (F.col("__before") + F.col("__pos") + 1).cast("long")).drop("__before", "__pos")


def sorted_bounds(df: DataFrame, key: Names, value: Column, name: str = "bounds") -> DataFrame:
    """The distinct values of each key in order."""
    return df.select(*key, value.alias("__v")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("__v")).alias(name))


def common_scale(df: DataFrame, key: Names, width: str, target: float, name: str = "factor") -> DataFrame:
    """The factor that makes the widest row of a key ``target`` wide."""
    return df.withColumn(name, F.lit(float(target)) / F.max(width).over(Window.partitionBy(*key)))


def scaled_size(size: Column, factor: Column) -> Column:
    """A size times a factor, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(size * factor, 0)).cast("int")


def step_check(df: DataFrame, key: Names, order: Names, offset: str, unresolved: Column, window: Column) -> DataFrame:
    """Largest step and number of unresolved ones of each sequence; ``ok`` is null for under two offsets, else no step
    reaches the window and none is unresolved."""
    jumps = df.withColumn("__jump", F.col(offset) - F.lag(offset).over(_window(key, order))).withColumn("__window", window)
    out = jumps.groupBy(*key).agg(F.count("*").alias("n"), F.max("__jump").alias("max_jump"), F.sum(unresolved.cast("int")).alias("unresolved"), F.max("__window").alias("window"))
    return out.withColumn("ok", F.when(F.col("n") >= 2, (F.col("max_jump") < F.col("window")) & (F.col("unresolved") == 0)))


def free_numbers(wanted: DataFrame, taken: DataFrame, key: Names, order: Names, name: str = "k") -> DataFrame:
    """The least numbers from 1 that no row of ``taken`` (key, number) has, one for each wanted row of a key, in order.

    Of the sorted taken numbers t1 < t2 < ..., ti lies before the r-th free one if ti - i < r.
    """
    used = taken.select(*key, "number").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("number")).alias("__used"))
    placed = number(wanted, key, order, "__rank").join(used, list(key), "left")
    before = F.transform("__used", lambda t, i: t - i - 1)
    passed = F.coalesce(F.size(F.filter(before, lambda d: d < F.col("__rank") + 1)), F.lit(0))
    return placed.withColumn(name, F.col("__rank") + 1 + passed).drop("__rank", "__used")
