"""Removal of passages that repeat across documents, by Rabin-Karp hashes of every window of ``WINDOW`` words.

A window is removed if its words also start somewhere in a document with a smaller doc_id. The hash of a window is a
polynomial over word hashes, rolled along each whole text from prefix sums.

Counting. Windows are counted in Spark: each hash has the least doc_id that holds it, and windows of larger ids go. So
that a corpus need not ship a row a word, counting goes in three exact steps, each over what the one before left open:

1. Anchors. The least hash of the ``GRAM``-word grams of a window depends on its words alone, so equal windows have
   equal anchors. Stretches of neighbouring windows of one anchor, at most ``STRETCH`` of them, are one row; an anchor
   that occurs in one document only counts all of its windows as single.
2. Stretches. Equal stretches of equal anchors are counted as one: a passage that a third of all documents share, or a
   group of near copies, leaves one row for each of its stretches, combined on the map side. Where all stretches of an
   anchor are equal, their windows are counted with them.
3. Windows. Where they differ, each window of the distinct stretches is hashed and grouped; the least doc_id goes back to the
   stretches and from there to all documents that hold them.

Removed windows of a document merge into maximal intervals of words. A text that occurs in several rows is counted in
its row of least id; the other rows lose every window.

Windows are equal if anchor and window hash are, stretches if anchor and stretch hash are (64 bits each).

Defined results: a null or empty text has no words; texts under ``WINDOW`` words lose nothing; very long texts are hashed in
whole; a null doc_id counts as larger than any other; rows of one doc_id do not remove each other's windows, nor does a
document its own; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import WORD_BREAK, blocks, discard, documents, materialise, mix64, utf8_view
from strandloom.llm.shingles import _powers, word_hashes

WINDOW = 50
GRAM = 8
STRETCH = 64
BLOCK_BYTES = 1_000_000
_AS_IS = np.arange(256, dtype=np.uint8)
#: Place of a null doc_id among the others.
_LAST = 2**63 - 1
_KEY = ["r1", "r2"]


class Rolling:
    """Rabin-Karp hashes of any word range of a block, from prefix sums of a polynomial over word hashes."""

    def __init__(self, words: np.ndarray):
        power, self.inverse = _powers(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.inverse[start])


def _least_over(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours."""
    width = 1
    while 2 * width <= span:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def stretches(words: np.ndarray, bounds: np.ndarray, window: int):
    """Row, first and last window start (in the block), anchor and stretch hash of every stretch of a block's windows."""
    gram = min(GRAM, window)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    rolling = Rolling(words)
    at = np.arange(len(words) - gram + 1)
    anchor = _least_over(rolling.of(at, at + gram), window - gram + 1)
    row = np.searchsorted(bounds, np.arange(len(anchor)), side="right") - 1
    valid = np.arange(len(anchor)) + window <= bounds[row + 1]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    since = np.arange(len(anchor)) - np.maximum.accumulate(np.where(fresh, np.arange(len(anchor)), 0))
    fresh |= since % STRETCH == 0
    lo = np.flatnonzero(fresh & valid)
    last = np.ones(len(anchor), bool)
    last[:-1] = fresh[1:] | ~valid[1:]
    hi = np.flatnonzero(last & valid)
    return row[lo], lo, hi, anchor[lo], mix64(rolling.of(lo, hi + window) ^ (hi - lo).astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """One key for a text, wherever it stands, and the place of its document."""
    place = F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("place")
    return docs.select("doc_id", "text", place, F.xxhash64("text").alias("r1"), F.xxhash64(F.lit("another seed"), "text").alias("r2"))


def copies_of(keyed: DataFrame, window: int) -> DataFrame:
    """Key and least place of the texts that may hold a window and occur more than once."""
    long = keyed.filter(F.octet_length("text") >= 2 * window - 1)
    counted = long.groupBy(*_KEY).agg(F.count("*").alias("c"), F.min("place").alias("keeper"))
    return materialise(counted.filter("c > 1").select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "keeper"), "copied-texts")


def parse(keyed: DataFrame, window: int) -> DataFrame:
    """Key, place, lo, hi, anchor, stretch: the stretches of every whole text."""
    schema = T.StructType.fromDDL("r1 bigint, r2 bigint, place bigint, lo int, hi int, anchor bigint, stretch bigint")

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in (*_KEY, "place")]
            data, offsets = utf8_view(batch.column("text"))
            for start, end in blocks(offsets, BLOCK_BYTES):
                own = offsets[start : end + 1]
                words, bounds = word_hashes(data[own[0] : own[-1]], own - own[0], _AS_IS)
                row, lo, hi, anchor, stretch = stretches(words, bounds, window)
                base = bounds[row]
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array(k[start:end][row]) for c, k in zip((*_KEY, "place"), keys, strict=True)}, "lo": pa.array((lo - base).astype(np.int32)),
                    "hi": pa.array((hi - base).astype(np.int32)), "anchor": pa.array(anchor.view(np.int64)), "stretch": pa.array(stretch.view(np.int64)),
                })

    return keyed.filter(F.octet_length("text") >= 2 * window - 1).select(*_KEY, "place", "text").mapInArrow(run, schema)


def windows(told: DataFrame, window: int) -> DataFrame:
    """anchor, hash, stretch, at, place: the Rabin-Karp hash of every window of the listed stretches."""
    schema = T.StructType.fromDDL("anchor bigint, hash bigint, stretch bigint, at int, place bigint")

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            for i, units in enumerate(batch.column("units").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                lo, hi, place, anchor, stretch = (np.array([u[c] for u in units], np.int64) for c in ("lo", "hi", "place", "anchor", "stretch"))
                size = hi - lo + 1
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(lo, size) + at
                hashes = Rolling(word_hashes(own, np.array([0, len(own)]), _AS_IS)[0]).of(start, start + window)
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(np.repeat(anchor, size)), "hash": pa.array(hashes.view(np.int64)), "stretch": pa.array(np.repeat(stretch, size)),
                    "at": pa.array(at.astype(np.int32)), "place": pa.array(np.repeat(place, size)),
                })

    return told.select("text", "units").mapInArrow(run, schema)


def repeated(once: DataFrame, window: int) -> DataFrame:
    """Key and starts (array): the windows of each text that occur in a document of smaller place. ``once`` holds each text in its row of least place.

    Tables that a join below reads are stored, so that the rows of a frequent anchor may be split.
    """
    parsed = materialise(parse(once, window), "stretches")
    several = parsed.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a < b").select("anchor")
    several = materialise(several, "shared-anchors")
    hits = materialise(parsed.join(several, "anchor"), "shared-stretches")
    discard(parsed, several)
    firsts = hits.groupBy("anchor", "stretch").agg(F.min(F.struct("place", *_KEY, "lo", "hi")).alias("first"))
    firsts = materialise(firsts.select("anchor", "stretch", "first.*"), "first-stretches")
    # where all stretches of an anchor are equal, so are their windows, and there are no others
    forked = materialise(firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "forked-anchors")
    units = firsts.join(forked, "anchor").groupBy(F.col("r1").alias("u1"), F.col("r2").alias("u2")).agg(
        F.collect_list(F.struct("lo", "hi", "place", "anchor", "stretch")).alias("units")
    )
    listed = once.join(units, (F.col("r1") == F.col("u1")) & (F.col("r2") == F.col("u2")))
    counted = materialise(windows(listed, window), "windows")
    least = counted.groupBy("anchor", "hash").agg(F.min("place").alias("keeper"), F.max("place").alias("most")).filter("keeper < most").drop("most")
    least = materialise(least, "repeated-windows")
    earlier = counted.join(least, ["anchor", "hash"]).filter("keeper < place").groupBy("anchor", "stretch").agg(F.collect_list(F.struct("at", "keeper")).alias("earlier"))
    known = firsts.select("anchor", "stretch", F.col("place").alias("own")).join(earlier, ["anchor", "stretch"], "left")
    known = materialise(known, "keepers")
    single = F.transform(F.filter("earlier", lambda x: x["keeper"] < F.col("place")), lambda x: F.col("lo") + x["at"])
    gone = F.when(F.col("own") < F.col("place"), F.sequence("lo", "hi")).otherwise(single)
    marks = hits.join(known, ["anchor", "stretch"]).select(*_KEY, gone.alias("gone")).filter(F.size("gone") > 0)
    starts = materialise(marks.groupBy(F.col("r1").alias("s1"), F.col("r2").alias("s2")).agg(F.flatten(F.collect_list("gone")).alias("starts")), "starts")
    discard(hits, firsts, forked, counted, least, known)
    return starts


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, whole and starts: of a text whose copy has a smaller id all windows go, else those that start at ``starts``."""
    keyed = _keyed(docs)
    copies = copies_of(keyed, window)
    told = keyed.join(copies, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")), "left")
    later = F.coalesce(F.col("place") > F.col("keeper"), F.lit(False))
    starts = repeated(told.filter(~later).select(*_KEY, "place", "text"), window)
    first = told.filter(~later).join(starts, (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")), "left")
    return first.select("doc_id", "text", F.lit(False).alias("whole"), "starts").unionByName(
        told.filter(later).select("doc_id", "text", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    )


def intervals(starts, window: int) -> list[list[int]]:
    """Maximal runs [first, end) of the words that windows of these starts cover."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return out


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (intervals of words) and kept (the words that stay, joined by one space)."""
    return _cut(removed(docs, window), window, "kept string", lambda kept: kept)


def _cut(frame: DataFrame, window: int, last: str, shown) -> DataFrame:
    schema = T.StructType.fromDDL(f"doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, spans array<array<int>>, {last}")

    def run(batches):
        for batch in batches:
            rows = []
            for text, whole, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "starts")), strict=True):
                words = (text or "").encode().split()
                spans = [[0, len(words)]] if whole and len(words) >= window else intervals(starts or [], window)
                edges = [0, *(x for span in spans for x in span), len(words)]
                kept = b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])
                rows.append((len(words), sum(b - a for a, b in spans), len(spans), spans, shown(kept)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
            arrays = [pa.array(c, pa.list_(k) if i == 3 else k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], [f.name for f in schema])

    return frame.mapInArrow(run, schema)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(removed(documents(spark, sf_dir)), WINDOW, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest()).drop("n_spans", "spans")


#: Every window as its words; nothing is hashed or sieved.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {_LAST}) AS place,
         list_filter(string_split_regex(coalesce(text, ''), '{WORD_BREAK}'), lambda w: w <> '') AS w
  FROM documents),
windows AS (
  SELECT r, place, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, place, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
gone AS (SELECT r, i FROM (SELECT r, place, i, min(place) OVER (PARTITION BY g) AS keeper FROM windows) WHERE keeper < place),
covered AS (SELECT r, list(DISTINCT i + k) AS gone_at FROM gone, range(0, {WINDOW}) AS x(k) GROUP BY r),
kept AS (
  SELECT a.r, list(w[a.i] ORDER BY a.i) AS kept
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) a
  ANTI JOIN (SELECT r, unnest(gone_at) AS i FROM covered) c ON a.r = c.r AND a.i = c.i GROUP BY a.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone_at), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN covered ON d.r = covered.r LEFT JOIN kept ON d.r = kept.r
"""
