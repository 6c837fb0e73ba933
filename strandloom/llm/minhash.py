"""Near-duplicate groups of documents: SuperMinHash, banding, verification, union of verified links.

1. Each whole text becomes its set of word shingles and a SuperMinHash signature of ``BANDS * ROWS``
   places. Texts of one set collapse to the least doc_id before anything else, with map-side
   combination, however many copies there are.
2. Signatures are cut into bands; equal bands form buckets. Two sets of similarity 0.8 share no band
   with probability (1 - 0.8**4)**32 < 5e-8.
3. In each bucket all members are verified against a pivot, on full sets: the member that meets most
   others over all its buckets, which for a family of copies is the one closest to its source.
   Verified links connect; a bucket whose members are connected is done.
4. The members of open buckets of up to ``SMALL`` are candidates in pairs. Larger ones are split again
   by longer pieces of the signature, of ``PIECE`` places; members of such a piece are verified
   against one of them, which connects most of what is linked at a cost in proportion to the members.
5. What is still open: buckets whose pivots are of one component share one pivot. Let P be its set p
   and all elements that more than ``SMALL`` members of p's buckets have besides. If x and y are
   linked, |x n y| >= 4/9 (|x| + |y|), and there are two cases. They share an element outside P: such
   elements are held by few, whose pairs are candidates. Or x n y lies in P: then |x n P| and |y n P|
   both reach 4/9 (|x| + |y|); members for which that is possible are near, and near ones outside the
   largest component meet near ones of fitting size, in salted parts of a group.

A candidate is verified only if it joins two components and its bitmaps allow it: a bitmap holds the
parity of the elements that fall on each bit, two bitmaps differ in at most |x ^ y| bits, and a link
needs |x ^ y| <= (|x| + |y|) / 9. So no link is lost, and what is shipped with texts follows the
links, not the pairs of a group; near ones are compared within the join and not emitted before.

Sets have keys of their own: rows of one doc_id with unlike texts are told apart.

Defined results: a null doc_id takes part like any other and is never the least of its component (a
component of null ids alone has a null component_id); a text without words has an empty set and
links to nothing; null and empty texts are alike; repeated rows stay separate rows of one component;
other columns are ignored. ``keep_one`` keeps one row of each component, the one of least doc_id (of
rows that agree in doc_id and text, any one), and every row without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import discard, documents, materialise, mix64
from strandloom.llm.components import connect
from strandloom.llm.shingles import _PLACE, shingle_sets, super_minhash

BANDS, ROWS = 32, 4
#: Buckets of up to so many sets are verified in pairs, larger ones through pivots.
SMALL = 48
#: Ratio of the size classes.
CLASS = 1.005
#: Places of a longer piece of a signature.
PIECE = 8
#: Members of a hot group that are compared in one part, and rows of a hot pivot that are paired in one.
PART = 2_000
#: Links need PER * intersection >= LEAST * union.
LEAST, PER = 80, 100


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash of the text, set size, two sums that identify the set, and the keys of the bands."""
    schema = T.StructType.fromDDL("doc_id bigint, th bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>")
    which = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            n, s1, s2, bands = [], [], [], []
            for _, elements, bounds in shingle_sets(batch.column("text"), k):
                n.append(np.diff(bounds))
                for out, values in ((s1, elements), (s2, mix64(elements + _PLACE[62]))):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
                    out.append(total[bounds[1:]] - total[bounds[:-1]])
                signature = super_minhash(elements, bounds, BANDS * ROWS).reshape(-1, BANDS, ROWS)
                bands.append(mix64((mix64(signature) * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) ^ which))
            n, s1, s2 = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, s1, s2))
            bands = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.uint64)
            held = n > 0
            offsets = np.concatenate(([0], np.cumsum(held * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "th": batch.column("th"), "n": pa.array(n.astype(np.int64)), "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)),
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[held].reshape(-1).view(np.int64))),
            })

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def _parts(rows: DataFrame, key: list[str]) -> DataFrame:
    """key and ``parts``: how many salted parts the rows of a key make."""
    return rows.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))


def _paired(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) with both whole texts; the rows of a hot b are dealt over parts."""
    pairs = pairs if hasattr(pairs, "stored_at") else materialise(pairs, "pairs")
    first = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    parts = _parts(pairs, ["b"]).filter("parts > 1")
    second = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).join(parts, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = pairs.join(parts, "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    return dealt.join(first, "a").join(second, ["b", "part"]).select("a", "b", "text_a", "text_b")


def _sets(batch: pa.RecordBatch, name: str, k: int) -> list[np.ndarray]:
    out = []
    for _, elements, bounds in shingle_sets(batch.column(name), k):
        out += np.split(elements, bounds[1:-1])
    return out


def _shared(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which elements of the sorted set x are in the sorted set p."""
    at = np.minimum(np.searchsorted(p, x), len(p) - 1)
    return p[at] == x


def verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that are linked, judged on full sets."""

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(_sets(batch, "text_a", k), _sets(batch, "text_b", k), strict=True):
                both = int(_shared(x, y).sum()) if len(x) and len(y) else 0
                linked.append(bool(both) and PER * both >= LEAST * (len(x) + len(y) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(mask) for c in ("a", "b")})

    return _paired(pairs, texts).mapInArrow(run, T.StructType.fromDDL("a bigint, b bigint"))


def outside(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(b, element, a, n, inside) of each element that member a has and its pivot b lacks; one null element if none."""

    def run(batches):
        for batch in batches:
            elements, members, pivots, sizes, common = [], [], [], [], []
            ids = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            for (a, b), x, p in zip(ids, _sets(batch, "text_a", k), _sets(batch, "text_b", k), strict=True):
                own = x[~_shared(x, p)]
                inside, rows = len(x) - len(own), max(1, len(own))
                elements.append(own.view(np.int64) if len(own) else np.zeros(1, np.int64))
                for out, value in ((members, a), (pivots, b), (sizes, len(x)), (common, inside)):
                    out.append(np.full(rows, value, np.int64))
            columns = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (pivots, elements, members, sizes, common))
            yield pa.RecordBatch.from_pydict(dict(zip(("b", "element", "a", "n", "inside"), map(pa.array, columns), strict=True)))

    return _paired(pairs, texts).mapInArrow(run, T.StructType.fromDDL("b bigint, element bigint, a bigint, n bigint, inside bigint"))


def bitmaps(texts: DataFrame, k: int) -> DataFrame:
    """(rep, width, bits): parity of the elements on each of ``width`` bits, for all widths that partners of a fitting size may have."""

    def run(batches):
        for batch in batches:
            reps, widths, bits = [], [], []
            for rep, x in zip(batch.column("rep").to_pylist(), _sets(batch, "text", k), strict=True):
                width = 1 << max(6, int(1.5 * len(x)).bit_length())
                last = 1 << max(6, int(2.6 * len(x)).bit_length())
                while width <= last:
                    odd = np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    reps.append(rep)
                    widths.append(width)
                    bits.append(np.packbits(odd.astype(bool)).view(np.int64))
                    width *= 2
            bounds = np.concatenate(([0], np.cumsum([len(b) for b in bits]))).astype(np.int32)
            flat = np.concatenate(bits) if bits else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "width": pa.array(widths, pa.int64()), "bits": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))})

    return texts.select("rep", "text").mapInArrow(run, T.StructType.fromDDL("rep bigint, width bigint, bits array<bigint>"))


def _fits(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be linked."""
    return (n * PER >= m * LEAST) & (m * PER >= n * LEAST)


def _differ_little(x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """Whether two bitmaps allow a link."""
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return differing * (PER + LEAST) <= (nx + ny) * (PER - LEAST)


def _across(groups: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (a, b, na, nb) of fitting size and different components in groups of up to SMALL (rep, n, component); equal groups count once."""
    gathered = groups.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rep", "n", "component"))).alias("m")).select("m").distinct()
    each = gathered.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    wanted = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _fits(F.col("x.n"), F.col("y.n"))
    return each.filter(wanted).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def _named(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` with the component of its column ``rep``."""
    return df.join(labels.select("node", F.col("component").alias("__found")), F.col("rep") == F.col("node"), "left").select(*df.columns, F.coalesce("__found", "rep").alias("component"))


def _width(n: Column) -> Column:
    """Bits for sets of up to n elements."""
    return F.pow(F.lit(2), F.greatest(F.lit(6), F.ceil(F.log2(n.cast("double")) + 1))).cast("long")


def _with_bits(df: DataFrame, drawn: DataFrame, rep: str, bits: str) -> DataFrame:
    """``df`` (rep, width) with the set's bitmap of that width."""
    return df.join(drawn.select(F.col("rep").alias(rep), "width", F.col("bits").alias(bits)), [rep, "width"])


def sift(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The distinct pairs (a, b, na, nb) whose bitmaps allow a link."""
    sized = pairs.distinct().withColumn("width", _width(F.greatest("na", "nb")))
    both = _with_bits(_with_bits(sized, drawn, "a", "bits_a"), drawn, "b", "bits_b")
    return both.filter(_differ_little(F.col("bits_a"), F.col("bits_b"), F.col("na"), F.col("nb"))).select("a", "b")


def split_pairs(members: DataFrame, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with one other of its longer piece of the signature, where their components differ."""
    step = PIECE // ROWS
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("bands", i * step + 1, step)) for i in range(BANDS // step)))
    rows = members.select("rep").distinct().join(copies.select("rep", "bands"), "rep").select("rep", F.explode(keys).alias("piece"))
    rows = materialise(_named(rows, labels), "pieces")
    heads = rows.groupBy("piece").agg(F.min("rep").alias("head"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    heads = heads.join(labels, F.col("head") == F.col("node"), "left").select(F.col("piece").alias("__piece"), "head", F.coalesce("component", "head").alias("home"))
    return rows.join(heads, F.col("piece") == F.col("__piece")).filter("component <> home").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()


def hot_pairs(large: DataFrame, labels: DataFrame, texts: DataFrame, drawn: DataFrame, k: int) -> DataFrame:
    """Pairs still to verify in open buckets of more than SMALL members (rep, pivot, met): step 5."""
    # one pivot serves all buckets whose pivots are of one component: the one that meets most
    pivots = large.select(F.col("pivot").alias("b"), "met").distinct()
    pivots = pivots.join(labels, F.col("b") == F.col("node"), "left").select("b", "met", F.coalesce("component", "b").alias("home"))
    roots = materialise(pivots.groupBy("home").agg(F.max_by("b", F.struct("met", (-F.col("b")).alias("less"))).alias("root")), "roots")
    served = materialise(pivots.join(roots, "home").select(F.col("b").alias("pivot"), "root"), "served")
    pairs = large.select("rep", "pivot").distinct().join(served, "pivot").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    pairs = pairs.unionByName(served.select(F.col("pivot").alias("a"), F.col("root").alias("b"))).distinct()
    parts = materialise(outside(pairs, texts, k), "outside")
    held = materialise(parts.groupBy("b", "element").agg(F.count("*").alias("held")).filter("held > 1"), "held")
    few = parts.join(held.filter(F.col("held") <= SMALL), ["b", "element"]).select("b", "element", F.col("a").alias("rep"), "n")
    pairs = sift(_across(_named(few, labels), ["b", "element"]), drawn)
    many = held.filter(F.col("held") > SMALL).select("b", "element", F.lit(1).alias("many"))
    inside = F.max("inside") + F.sum(F.when(F.col("inside") < F.col("n"), F.coalesce("many", F.lit(0))).otherwise(0))
    each = parts.join(many, ["b", "element"], "left").groupBy("b", "a", "n").agg(inside.alias("inside"))
    near = materialise(_named(each.filter(F.col("inside") * PER >= F.col("n") * LEAST).withColumnRenamed("a", "rep"), labels), "near")
    return pairs.unionByName(near_pairs(near, drawn)).distinct()


def near_pairs(near: DataFrame, drawn: DataFrame) -> DataFrame:
    """Candidates (a, b) among near members (b, rep, n, inside, component) that join components: the second case of step 5."""
    homes = near.groupBy("b", "component").agg(F.count("*").alias("c")).groupBy("b").agg(F.max_by("component", F.struct("c", "component")).alias("home"))
    near = materialise(near.join(homes, "b"), "near-homes")
    most = (F.col("inside") * (PER + LEAST) / LEAST - F.col("n")).alias("most")
    size = lambda n: F.floor(F.log(F.greatest(F.lit(1), n).cast("double")) / float(np.log(CLASS))).cast("int")
    width = _width(F.pow(F.lit(CLASS), F.col("size") + 1)).alias("width")
    least = size(F.floor(F.col("n") * LEAST / PER))
    lone = near.filter("component <> home").select(
        "b", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), "home", most, F.explode(F.sequence(least, F.greatest(size(most), least))).alias("size"),
    )
    rest = near.select("b", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), most.alias("most_y"), size(F.col("n")).alias("size"))
    shared = rest.select("b", "size").distinct()
    lone = materialise(lone.join(shared, ["b", "size"], "left_semi"), "lone")
    parts = materialise(_parts(lone, ["b", "size"]), "parts")
    lone = lone.join(parts, ["b", "size"]).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).select("*", width)
    rest = rest.join(parts, ["b", "size"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("*", width).drop("parts")
    lone, rest = _with_bits(lone, drawn, "x", "bits_x").drop("width", "parts"), _with_bits(rest, drawn, "y", "bits_y").drop("width")
    once = (F.col("cy") == F.col("home")) | (F.col("x") < F.col("y"))  # a pair of two lone members meets from both sides
    allowed = (F.col("cx") != F.col("cy")) & once & (F.col("ny") <= F.col("most")) & (F.col("nx") <= F.col("most_y"))
    met = lone.join(rest, ["b", "size", "part"]).filter(allowed & _differ_little(F.col("bits_x"), F.col("bits_y"), F.col("nx"), F.col("ny")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def with_pivots(rows: DataFrame) -> DataFrame:
    """Members (key, rep, n, c, pivot, met) of the buckets of two or more."""
    shared = materialise(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "buckets")
    members = materialise(rows.join(shared, "key"), "bucket-members")
    met = members.groupBy(F.col("rep").alias("m_rep")).agg(F.sum("c").alias("met"))
    best = members.join(met, F.col("rep") == F.col("m_rep")).groupBy("key").agg(F.max(F.struct("met", (-F.col("n")).alias("small"), (-F.col("rep")).alias("less"))).alias("best"))
    best = materialise(best.select("key", (-F.col("best")["less"]).alias("pivot"), F.col("best")["met"].alias("met")), "pivots")
    out = materialise(members.join(best, "key"), "members")
    discard(shared, members, best)
    return out


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that hold more than one."""
    labelled = _named(members, labels)
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return labelled.join(split, "key")


def grouped(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n, component (null without words) and component_id of every row."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    sketches = materialise(sketch(docs, k), "sketches")
    identity = ["n", "s1", "s2"]
    at = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("at")
    copies = sketches.filter("n > 0").groupBy(*identity).agg(at, F.first("bands").alias("bands"))
    copies = materialise(copies.select(*identity, "at.doc_id", "at.th", "bands", F.monotonically_increasing_id().alias("rep")), "copies")
    members = with_pivots(copies.select(F.explode("bands").alias("key"), "rep", "n"))
    wanted = members.select("rep").distinct().join(copies.select("rep", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")), "rep")
    held = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("w_id")) & (docs["th"] == F.col("w_th"))).select("rep", "text")
    texts = materialise(held.dropDuplicates(["rep"]), "texts")
    stars = materialise(members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    links = materialise(verify(stars, texts, k), "links")
    labels = materialise(connect(links), "labels")
    open_ = materialise(_open(members, labels), "open")
    drawn = materialise(bitmaps(texts.join(open_.select("rep").distinct(), "rep"), k), "bitmaps")
    pairs = sift(_across(open_.filter(F.col("c") <= SMALL), ["key"]).join(stars, ["a", "b"], "left_anti"), drawn)
    links = links.unionByName(materialise(verify(pairs, texts, k), "links"))
    large = open_.filter(F.col("c") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(materialise(verify(split_pairs(large, labels, copies), texts, k), "links"))
        labels = materialise(connect(links), "labels")
        last = materialise(_open(large.drop("component"), labels).filter("rep <> pivot").drop("component"), "last")
        links = links.unionByName(materialise(verify(hot_pairs(last, labels, texts, drawn, k), texts, k), "links"))
    labels = connect(links)
    named = _named(copies.select(*identity, "doc_id", "rep"), labels)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.join(least, "component").select(*identity, "component", "component_id"), "named")
    discard(members, texts, stars, open_, copies, drawn)
    out = sketches.join(named, identity, "left")
    return out.select("doc_id", "th", "n", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links) of each document."""
    return grouped(docs, k).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """One document of each group, the least doc_id, with the input's columns; all documents without words."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("at")
    kept = grouped(docs, k).filter("component IS NOT NULL").groupBy("component").agg(least).select(F.col("at.doc_id").alias("__id"), F.col("at.th").alias("__kept"))
    hashed = docs.withColumn("__th", F.xxhash64("text"))
    chosen = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__kept")), "left_semi").dropDuplicates(["doc_id", "__th"])
    wordless = hashed.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return chosen.unionByName(wordless).drop("__th")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), 4)
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
