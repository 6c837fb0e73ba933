"""Removal of long repeated byte strings by prefix-free parsing.

Parsing. A rolling hash runs over all windows of ``TRIGGER`` bytes. In every string of ``length``
bytes the least such hash is its trigger, so the trigger depends on the string alone. Runs of
starts with one trigger are the phrases: the strings that start at lo..hi, which together span
text[lo : hi + length]. Neighbouring phrases overlap, and no phrase is cut differently elsewhere
for what surrounds it: a string that occurs twice has its trigger at the same place both times.

Dictionary and parse. A trigger that occurs once cannot belong to a repeated string. A phrase that
occurs twice in the parse is repeated as a whole, and takes no further part but for one copy in the
dictionary. What remains are different phrases around one trigger. Their suffixes are ranked by
prefix doubling up to ``length`` bytes, on bytes, not hashes; the starts that tie there are
neighbours in corpus order with a common prefix of ``length`` or more: repeated strings.

A text that occurs more than once loses all of its strings; one copy of it takes part in the parse
for the sake of other texts, and equal texts share one key of 128 bits of hash.

As a phrase spans ``length`` bytes or more, the parse's suffixes need no more than their first phrase
to be told apart at that depth: their order is that of the phrases, and neighbours of one phrase are
its occurrences. Which phrases are equal is decided by the two 64-bit hashes of trigger and phrase.

The dictionary is partitioned by the middle of the strings, which equal strings have in common.
Should more than ``CROWD`` phrases share one middle, they are not ranked in one task; their starts
are grouped by 128 bits of hash instead.

The order of suffixes that no repeat can touch is never made: it would need a sort of the whole
corpus and changes nothing.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; repeated rows are
repeats of each other; a run of one byte repeats itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import blocks, discard, documents, materialise, mix64, utf8_view
from strandloom.llm.shingles import _BYTE, _powers

LENGTH = 200
TRIGGER = 32
#: Parts into which the starts of a phrase are cut by their distance from the trigger.
PARTS = 4
CROWD = 5_000
BLOCK_BYTES = 1_000_000
#: Bytes of dictionary that are ranked together, whole groups at a time.
RANK_BYTES = 2_000_000

_OTHER = mix64(_BYTE)


class Hashes:
    """Hash of any substring of a block in constant time, from prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        power, self.inverse = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.inverse[start])


def phrases(data: np.ndarray, bounds: np.ndarray, length: int):
    """Row, first and last start, trigger place, trigger hash and phrase hash of every phrase of a block."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    at = np.arange(n - TRIGGER + 1)
    grams = hashes.of(at, at + TRIGGER)
    bits = np.uint64((1 << int(n).bit_length()) - 1)
    least = (grams & ~bits) | at.astype(np.uint64)
    span, width = length - TRIGGER + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & bits).astype(np.int64)
    # a start is valid while its string ends within its own row
    valid = np.zeros(len(place), bool)
    edge = np.zeros(len(place) + 1, np.int32)
    whole = np.flatnonzero(np.diff(bounds) >= length)
    np.add.at(edge, bounds[whole], 1)
    np.add.at(edge, bounds[whole + 1] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    change[bounds[whole]] = True
    lo = np.flatnonzero(valid & change)
    last = np.ones(len(place), bool)
    last[:-1] = change[1:] | ~valid[1:]
    hi = np.flatnonzero(valid & last)
    trigger = place[lo]
    shape = ((hi - lo) * 1024 + (trigger - lo)).astype(np.uint64)
    return np.searchsorted(bounds, lo, side="right") - 1, lo, hi, trigger, grams[trigger], mix64(hashes.of(lo, hi + length) ^ shape)


_KEY = ["r1", "r2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """One key for a text, wherever it stands and also where ids repeat or are null."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("r1"), F.xxhash64(F.lit("another seed"), "text").alias("r2"))


def copies_of(keyed: DataFrame, length: int) -> DataFrame:
    """Key, size, and least doc_id of the texts of ``length`` bytes or more that occur more than once."""
    size = F.octet_length("text")
    long = keyed.filter(size >= length).groupBy(*_KEY).agg(F.count("*").alias("c"), F.max(size).alias("size"), F.min("doc_id").alias("keeper"))
    return materialise(long.filter("c > 1").select(*_KEY, "size", "keeper"), "copies")


def parse(keyed: DataFrame, length: int) -> DataFrame:
    """Key, lo, hi, place (of the trigger), trigger, phrase: the parse of every whole text."""
    schema = T.StructType.fromDDL("r1 bigint, r2 bigint, lo int, hi int, place int, trigger bigint, phrase bigint")

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in _KEY]
            data, offsets = utf8_view(batch.column("text"))
            for start, end in blocks(offsets, BLOCK_BYTES):
                own = offsets[start : end + 1]
                bounds = own - own[0]
                row, lo, hi, place, trigger, phrase = phrases(data[own[0] : own[-1]], bounds, length)
                base = bounds[row] if len(row) else row
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array(k[start:end][row]) for c, k in zip(_KEY, keys, strict=True)}, "lo": pa.array((lo - base).astype(np.int32)), "hi": pa.array((hi - base).astype(np.int32)),
                    "place": pa.array((place - base).astype(np.int32)), "trigger": pa.array(trigger.view(np.int64)), "phrase": pa.array(phrase.view(np.int64)),
                })

    return keyed.select(*_KEY, "text").mapInArrow(run, schema)


def dictionary(told: DataFrame, length: int) -> DataFrame:
    """Parts of dictionary phrases: middle, key, first (start in the text), body (bytes), single (occurs once).

    ``told`` holds each document once, with the list ``units`` of its dictionary phrases.
    """
    schema = T.StructType.fromDDL("middle bigint, r1 bigint, r2 bigint, first int, body binary, single boolean")
    reach = length - TRIGGER + 1
    cuts = [reach * i // PARTS for i in range(PARTS + 1)]

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [], [])
            for r1, r2, text, units in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "text", "units")), strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                hashes = Hashes(data)
                lo, hi, place, single = (np.array([u[c] for u in units], np.int64) for c in ("lo", "hi", "place", "single"))
                for near, far in zip(cuts, cuts[1:], strict=False):
                    # starts whose distance to the trigger is in [near, far) all cover the same middle
                    first, last = np.maximum(lo, place - far + 1), np.minimum(hi, place - near)
                    held = np.flatnonzero(first <= last)
                    if not len(held):
                        continue
                    middle = hashes.of(place[held] - near, place[held] - far + 1 + length) + np.uint64(near)
                    out[0].append(mix64(middle).view(np.int64))
                    out[1].append(np.full(len(held), r1, np.int64))
                    out[2].append(np.full(len(held), r2, np.int64))
                    out[3].append(first[held].astype(np.int32))
                    out[4].extend(raw[a : b + length] for a, b in zip(first[held].tolist(), last[held].tolist(), strict=True))
                    out[5].append(single[held].astype(bool))
            flat = [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out[:4], (np.int64, np.int64, np.int64, np.int32), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "middle": pa.array(flat[0]), "r1": pa.array(flat[1]), "r2": pa.array(flat[2]), "first": pa.array(flat[3]), "body": pa.array(out[4], pa.binary()),
                "single": pa.array(np.concatenate(out[5]) if out[5] else np.zeros(0, bool)),
            })

    return told.select(*_KEY, "text", "units").mapInArrow(run, schema)


def depth_ranks(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each place among all, compared to ``length`` bytes; -1 where fewer are left.

    Prefix doubling: ranks of pairs of shorter ranks are ranks of twice the depth.
    """
    left = ends - np.arange(len(data))
    rank, depth = data.astype(np.int64), 1
    while depth < length:
        step = min(depth, length - depth)
        held = np.flatnonzero(left >= depth + step)
        _, order = np.unique(rank[held] * (len(data) + 256) + rank[held + step], return_inverse=True)
        rank = np.full(len(data), -1, np.int64)
        rank[held] = order
        depth += step
    return rank


def _tied(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its starts are strings that occur in another place of the dictionary."""
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(sizes)
    rank = depth_ranks(data, np.repeat(ends, sizes), length)
    held = rank >= 0
    tie = np.zeros(len(data), bool)
    tie[held] = np.bincount(rank[held])[rank[held]] > 1
    return [tie[e - s : e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).reshape(-1, 2)


def _intervals(keys, firsts, flags, length: int) -> pa.RecordBatch:
    rows = [(*r, f + a, f + b - 1 + length) for r, f, t in zip(keys, firsts, flags, strict=True) for a, b in _runs(t).tolist()]
    r1, r2, start, end = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(r1, pa.int64()), pa.array(r2, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [*_KEY, "start", "end"])


_SPANS = "r1 bigint, r2 bigint, start int, end int"


def rank_dictionary(parts: DataFrame, length: int) -> DataFrame:
    """Intervals (key, start, end) of repeated strings in single phrases; whole groups of a middle meet in a task."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("middle", *_KEY, "first", "body", "single")), strict=True):
                if size >= RANK_BYTES and row[0] != held[-1][0]:
                    yield ranked(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield ranked(held)

    def ranked(rows: list[tuple]) -> pa.RecordBatch:
        flags = _tied([r[4] for r in rows], length)
        told = [(r[1:3], r[3], f) for r, f in zip(rows, flags, strict=True) if r[5]]
        return _intervals(*(zip(*told, strict=True) if told else ((), (), ())), length)

    return parts.repartition("middle").sortWithinPartitions("middle").select("middle", *_KEY, "first", "body", "single").mapInArrow(run, T.StructType.fromDDL(_SPANS))


def group_crowded(parts: DataFrame, length: int) -> DataFrame:
    """As :func:`rank_dictionary`, for middles of any number of phrases: starts are grouped by hash, with map-side counts."""

    def run(batches):
        for batch in batches:
            for body, r1, r2, first, single in zip(*(batch.column(c).to_pylist() for c in ("body", *_KEY, "first", "single")), strict=True):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - length + 1)
                one, two = (Hashes(data, t).of(at, at + length).view(np.int64) for t in (_BYTE, _OTHER))
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array(one), "h2": pa.array(two), "r1": pa.array(np.full(len(at), r1)), "r2": pa.array(np.full(len(at), r2)), "start": pa.array((first + at).astype(np.int32)),
                    "single": pa.array(np.full(len(at), single)),
                })

    schema = T.StructType.fromDDL("h1 bigint, h2 bigint, r1 bigint, r2 bigint, start int, single boolean")
    starts = materialise(parts.select("body", *_KEY, "first", "single").mapInArrow(run, schema), "crowded")
    twice = materialise(starts.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2"), "crowded-twice")
    return starts.filter("single").join(twice, ["h1", "h2"]).select(*_KEY, "start", (F.col("start") + length).alias("end"))


def repeated(keyed: DataFrame, length: int) -> DataFrame:
    """Intervals (key, start, end) that cover every byte of a repeated string; they may overlap. ``keyed`` holds each text once."""
    parsed = parse(keyed, length)
    twice = materialise(parsed.groupBy("trigger").agg(F.count("*").alias("c")).filter("c > 1").select("trigger"), "triggers")
    hits = materialise(parsed.join(twice, "trigger"), "hits")
    entries = hits.groupBy("trigger", "phrase").agg(F.count("*").alias("c"), F.min(F.struct(*_KEY, "lo", "hi", "place")).alias("at"))
    entries = materialise(entries, "entries")
    whole = hits.join(entries.filter("c > 1").select("trigger", "phrase"), ["trigger", "phrase"]).select(
        *_KEY, F.col("lo").alias("start"), (F.col("hi") + length).alias("end")
    )
    several = materialise(entries.groupBy("trigger").agg(F.count("*").alias("d")).filter("d > 1").select("trigger"), "several")
    units = entries.join(several, "trigger").select("at.*", (F.col("c") == 1).alias("single"))
    listed = units.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi", "place", "single")).alias("units"))
    parts = materialise(dictionary(keyed.join(listed, _KEY), length), "dictionary")
    counts = parts.groupBy("middle").agg(F.count("*").alias("m")).filter("m > 1")
    counts = materialise(counts, "middles")
    shared = parts.join(counts.filter(F.col("m") <= CROWD).select("middle"), "middle")
    spans = whole.unionByName(rank_dictionary(shared, length))
    crowded = counts.filter(F.col("m") > CROWD).select("middle")
    if not crowded.isEmpty():
        spans = spans.unionByName(group_crowded(parts.join(crowded, "middle"), length))
    spans = materialise(spans, "spans")
    discard(twice, hits, entries, several, parts, counts)
    return spans


def merge(starts, ends) -> np.ndarray:
    """Maximal disjoint runs (k x 2) of intervals in any order."""
    order = np.argsort(starts, kind="stable")
    s, reach = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return np.stack((s[first], reach[np.concatenate((first[1:] - 1, [len(s) - 1]))]), axis=1)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text and spans: the maximal runs of bytes to remove, as arrays ``starts`` and ``ends``."""
    keyed = _keyed(docs)
    copies = copies_of(keyed, length)
    kept = copies.select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "keeper", F.lit(True).alias("copied"))
    once = keyed.join(kept, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")), "left").filter(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("keeper")))
    spans = repeated(once.select(*_KEY, "text"), length)
    spans = spans.unionByName(copies.select(*_KEY, F.lit(0).alias("start"), F.col("size").alias("end")))
    listed = spans.groupBy(F.col("r1").alias("s1"), F.col("r2").alias("s2")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(listed, (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")), "left")
    return joined.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    return _cut(removed(docs, length), "kept binary", lambda kept: kept)


def _cut(frame: DataFrame, last: str, shown) -> DataFrame:
    name, kind = last.split()
    schema = T.StructType.fromDDL(f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")

    def run(batches):
        for batch in batches:
            counts, kept = [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                raw = (text or "").encode()
                runs = merge(starts, ends).tolist() if starts else []
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(shown(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                counts.append((len(raw), sum(b - a for a, b in runs), len(runs)))
            sizes = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes[:, 0]), "n_removed": pa.array(sizes[:, 1]), "n_spans": pa.array(sizes[:, 2]),
                name: pa.array(kept, pa.string() if kind == "string" else pa.binary()),
            })

    return frame.mapInArrow(run, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(removed(documents(spark, sf_dir)), "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())
