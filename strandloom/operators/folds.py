"""Order-dependent folds: what a window cannot say. They parallelise over sequences, not within one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.stored import ready


def penalty_score(issues: Column, low: Column, overlap: Column, cuts: Column, ink: Column) -> Column:
    """100 less the penalties of a report, not below 0, to one decimal."""
    lost = F.when(ink > 3000, 30).when(ink > 300, 10).otherwise(0)
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) - issues * 15 - low * 10 - overlap * 25 - cuts * 20 - lost, 1)).cast("double")


_STATE = "struct<at:int,value:int,kept:int,first:int,issues:array<struct<at:int,kind:string,before:int,after:int>>>"


def continuity(df: DataFrame, key: Sequence[str], order: Sequence[str], number: str) -> DataFrame:
    """Audit of readings that should rise by about one increment: issues, and whether half could be read.

    One row a sequence: n, n_read, tolerance, first, last, n_kept, issues. The fold runs inside the
    JVM over the sorted readings of a sequence, each with the reading after it.

    A reading follows the accepted one if it is not smaller and by at most the tolerance for each
    place between them. One that does not follow is ignored if the next does (a misread) or if it
    is over 20 tolerances away; else it is an issue and becomes the accepted one. The first that
    the second follows begins; under half of the places read, there are no issues.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(number).alias("v"))))
    seqs = df.groupBy(*key).agg(ordered.alias("rows")).withColumn("n", F.size("rows"))
    placed = F.transform("rows", lambda r, i: F.struct(i.alias("at"), r["v"].alias("v")))
    known = seqs.select(*key, "n", placed.alias("placed")).select(*key, "n", F.filter("placed", lambda x: x["v"].isNotNull()).alias("k"))
    following = F.transform("k", lambda x, i: F.struct(x["at"].alias("at"), x["v"].alias("v"), F.get("k", i + 1)["at"].alias("next_at"), F.get("k", i + 1)["v"].alias("next_v")))
    known = known.select(*key, "n", following.alias("k"))
    rises = F.transform(F.filter("k", lambda x: x["next_v"] > x["v"]), lambda x: (x["next_v"] - x["v"]) / (x["next_at"] - x["at"]))
    known = known.select("*", F.sort_array(rises).alias("rises"))
    m = F.size("rises")
    middle = (F.get("rises", ((m - 1) / 2).cast("int")) + F.get("rises", (m / 2).cast("int"))) / 2
    typical = F.when(m > 0, middle).otherwise(F.lit(1.0))
    known = known.select(*key, "n", "k", F.greatest(typical * 2, typical + 4).alias("tolerance"))

    def follows(at, value, at2, value2):
        gap = F.greatest(F.lit(1), at2 - at)
        return (value2 >= value) & (value2 - value <= F.col("tolerance") * gap)

    begins = F.get(F.filter("k", lambda x: F.coalesce(follows(x["at"], x["v"], x["next_at"], x["next_v"]), F.lit(False))), F.lit(0))
    known = known.select("*", F.coalesce(begins, F.get("k", F.lit(0))).alias("s"))
    zero = F.struct(F.col("s.at").alias("at"), F.col("s.v").alias("value"), F.lit(1).alias("kept"), F.col("s.v").alias("first"), F.array().alias("issues")).cast(_STATE)

    def step(s: Column, x: Column) -> Column:
        delta = x["v"] - s["value"]
        allowed = F.col("tolerance") * F.greatest(F.lit(1), x["at"] - s["at"])
        good = (delta >= 0) & (delta <= allowed)
        misread = F.coalesce(follows(s["at"], s["value"], x["next_at"], x["next_v"]), F.lit(False)) | (delta > allowed * 20)
        issue = F.struct(x["at"].alias("at"), F.when(delta < 0, "backwards").otherwise("gap").alias("kind"), s["value"].alias("before"), x["v"].alias("after"))
        moved = F.struct(
            x["at"].alias("at"), x["v"].alias("value"), (s["kept"] + 1).alias("kept"), s["first"].alias("first"),
            F.when(good, s["issues"]).otherwise(F.concat(s["issues"], F.array(issue))).alias("issues"),
        )
        return F.when((x["at"] <= s["at"]) | (~good & misread), s).otherwise(moved).cast(_STATE)

    done = known.select(*key, "n", F.size("k").alias("n_read"), "tolerance", F.when(F.size("k") > 0, F.aggregate("k", zero, step)).alias("f"))
    reliable = F.col("n_read") * 2 >= F.col("n")
    issues = F.when(reliable, F.col("f.issues")).otherwise(F.array().cast("array<struct<at:int,kind:string,before:int,after:int>>"))
    return done.select(*key, "n", "n_read", F.round("tolerance", 6).alias("tolerance"), reliable.alias("reliable"), F.col("f.first").alias("first"), F.col("f.value").alias("last"), F.col("f.kept").alias("n_kept"), F.coalesce(issues, F.array().cast("array<struct<at:int,kind:string,before:int,after:int>>")).alias("issues"))


def continuity_text(row: Column) -> Column:
    """The audit in words."""
    dropped = row["n_read"] - row["n_kept"]
    extra = F.when(dropped > 0, F.format_string(" (%d readings left out)", dropped)).otherwise("")
    said = F.array_join(F.transform(row["issues"], lambda i: F.concat(F.when(i["kind"] == "gap", "gap").otherwise("step back"), F.lit(" at "), i["before"].cast("string"), F.lit(" to "), i["after"].cast("string"))), ", ")
    return (
        F.when(row["n_read"] == 0, "nothing was read").when(~row["reliable"], F.format_string("unreliable: %d of %d places were read", row["n_read"], row["n"]))
        .when(F.size(row["issues"]) > 0, said).otherwise(F.concat(F.format_string("%d to %d without a gap", row["first"], row["last"]), extra))
    )


def _segment(vectors: np.ndarray, z_limit: float, floor: float, merge: float, near: int, least: int) -> list[int]:
    """Starts of the segments of one sequence of vectors."""
    n = len(vectors)
    if n < 2:
        return [0]
    step = np.linalg.norm(np.diff(vectors, axis=0), axis=1)
    off = np.abs(step - np.median(step))
    z = off / (1.4826 * (np.median(off) + 1e-6))
    odd = np.flatnonzero((z > z_limit) & (step / np.sqrt(vectors.shape[1]) > floor))
    events = np.split(odd, np.flatnonzero(np.diff(odd) > near) + 1) if len(odd) else []
    cuts = sorted({0, *(int(e[np.argmax(z[e])]) + 1 for e in events)})
    typical = np.median(step)
    middle = lambda i: np.median(vectors[cuts[i] : (cuts + [n])[i + 1]], axis=0)
    at = 1
    while at < len(cuts):  # a merged pair changes what is left of it, so the scan begins again
        if np.linalg.norm(middle(at) - middle(at - 1)) < merge * typical:
            del cuts[at]
            at = 1
        else:
            at += 1
    while len(cuts) > 1:
        sizes = np.diff([*cuts, n])
        k = int(np.argmin(sizes))
        if sizes[k] >= least:
            break
        left = k > 0 and (k == len(cuts) - 1 or np.linalg.norm(middle(k) - middle(k - 1)) <= np.linalg.norm(middle(k) - middle(k + 1)))
        del cuts[k if left else k + 1]
    return cuts


def segments(df: DataFrame, key: Sequence[str], order: Sequence[str], vector: str, z_limit: float = 4.0, floor: float = 3.0, merge: float = 1.5, near: int = 4, least: int = 20) -> DataFrame:
    """Segments (index, start, end, both included) of each sequence of vectors: cuts at outliers, like neighbours merged, short ones absorbed."""
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in key), *(T.StructField(c, T.IntegerType()) for c in ("index", "start", "end"))])

    def run(table: pa.Table) -> pa.Table:
        sorted_rows = table.select(list(order)).append_column("__at", pa.array(np.arange(len(table)))).sort_by([(c, "ascending") for c in (*order, "__at")])
        flat = table[vector].combine_chunks().flatten().to_numpy()  # one array of numbers, no list of Python floats
        vectors = flat.reshape(len(table), -1)[sorted_rows["__at"].to_numpy()].astype(np.float64)
        starts = _segment(vectors, z_limit, floor, merge, near, least)
        ends = [*(s - 1 for s in starts[1:]), len(table) - 1]
        keys = [pa.repeat(table[k][0], len(starts)) for k in key]
        return pa.Table.from_arrays([*keys, *(pa.array(x, pa.int32()) for x in (range(len(starts)), starts, ends))], [f.name for f in schema])

    ready(df.sparkSession)
    return df.select(*key, *order, vector).groupBy(*key).applyInArrow(run, schema)
