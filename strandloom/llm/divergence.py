"""Audit of how the sources of a language differ: smoothed term shares and their chi-square distance.

Every (lang, source) group gives each kept term of its language a share in parts of 10**9, p = 1 + floor(10**9 * (count + 1)
/ (N + V)). Part ``pair`` holds the distance of each ordered pair of sources of a language, the sum of f(p, q) =
floor((p - q)**2 / q) over all V kept terms; part ``term`` the terms that a source has more often than its language, by f.

Method: an inverted index with corrections to a baseline. If neither source held any term, each of the V terms would
give f(p0, q0), the shares of a zero count; the pair starts there. A term changes this only for the sources in its
postings list, and f splits over it without a remainder:

    sum f = V f(p0,q0) + sum over terms of a (f(p,q0) - f(p0,q0)) + sum over terms of b (f(p0,q) - f(p0,q0))
            + sum over terms of both (f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0))

The one-sided sums need the number of terms of each count only; the last one walks the postings list of a term, which
is as long as its sources are many. All of these rows are summed on the map side, so that what is shuffled is one row a
pair and task. Terms are ranked by windows with a limit.

At scale: texts are read once; tasks ship counts of (lang, source, term), combined up to ``HELD`` entries, so a source
with a third of all rows costs its tasks' vocabularies and no more. No list is longer than a language has sources.

Arithmetic is exact: products of counts are decimals, distances stay under 2**62 since shares sum to about 10**9.

Defined results: null text, lang and source are ''; empty texts have no terms, but their group counts; very long texts are
split piece by piece; equal values rank by the item's UTF-8 bytes; repeated rows count again; an empty table gives
no rows; a language without kept terms has distance 0 throughout; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import discard, documents, materialise
from strandloom.llm.terms import folding, pieces, terms_sql

PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language in which a kept term occurs at least.
LEAST_DOCUMENTS = 3
#: Ranks of part ``term``.
TOP = 200
PARTS = 1_000_000_000
#: Entries of the table of counts that a task combines before it ships them.
HELD = 400_000
_ROWS = 50_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of each term, combined within tasks."""
    table = folding()
    schema = T.StructType.fromDDL("lang string, source string, term string, count bigint, docs bigint")

    def shipped(held: dict):
        for (lang, source), (count, docs) in held.items():
            names = list(count)
            for at in range(0, len(names), _ROWS):
                part = names[at : at + _ROWS]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()), "term": pa.array(part, pa.binary()).cast(pa.string()),
                    "count": pa.array([count[t] for t in part], pa.int64()), "docs": pa.array([docs[t] for t in part], pa.int64()),
                })

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, source, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "raw")), strict=True):
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(count), set()
                for words in pieces(raw, table):
                    count.update(words)
                    own.update(words)
                docs.update(own)
                size += len(count) - before
                if size >= HELD:
                    yield from shipped(held)
                    held, size = {}, 0
        yield from shipped(held)

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select(_known("lang"), _known("source"), raw).mapInArrow(run, schema)


def _known(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def share(count: Column, n: Column, v: Column) -> Column:
    """Smoothed share of a count of n, in parts of 10**9 plus one, in whole numbers of any size."""
    return F.when(v > 0, F.call_function("div", F.lit(PARTS).cast("decimal(20,0)") * (count + 1).cast("decimal(18,0)"), (n + v).cast("decimal(38,0)")) + 1)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, count, total, leads): counts of the kept terms; ``leads`` is true once a term."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    told = counts.select(
        "lang", "term", "source", "count", F.sum("count").over(term).alias("total"), F.sum("docs").over(term).alias("in_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("leads"),
    )
    return told.filter(F.col("in_docs") >= least).drop("in_docs")


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, place, n, v, n_lang, p0): every group that occurs, numbered within its language."""
    occurring = docs.select(_known("lang"), _known("source")).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = postings.groupBy("lang").agg(F.sum(F.col("leads").cast("long")).alias("v"), F.sum("count").alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("place")
    return known.select("lang", "source", place, zero("n"), zero("v"), zero("n_lang")).withColumn("p0", share(F.lit(0).cast("long"), F.col("n"), F.col("v")))


def _corrections(priced: DataFrame, groups: DataFrame) -> list[DataFrame]:
    """Rows (lang, i, j, value) whose sums are the distances: the baseline, and what postings add to it."""
    other = groups.select("lang", F.col("place").alias("j"), F.col("p0").alias("q0"), "v")
    base = groups.select("lang", F.col("place").alias("i"), "p0").join(other, "lang").filter("i <> j")
    base = base.select("lang", "i", "j", F.coalesce(F.col("v") * distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))

    alike = priced.groupBy("lang", "place", "p0", "p").agg(F.count("*").alias("terms"))
    met = alike.join(other.drop("v"), "lang").filter("place <> j")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    ahead, behind = distance(p, q0) - distance(p0, q0), distance(q0, p) - distance(q0, p0)
    sums = met.groupBy("lang", "place", "j").agg(F.sum(F.col("terms") * ahead).alias("ahead"), F.sum(F.col("terms") * behind).alias("behind"))

    listed = priced.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "p", "p0"))).alias("posted"))
    first = listed.select("lang", "posted", F.posexplode("posted").alias("at", "a"))
    both = first.select("lang", "a", F.explode(F.slice("posted", F.col("at") + 2, F.size("posted"))).alias("b"))

    def crossing(x: str, y: str) -> Column:
        p, p0, q, q0 = (F.col(c) for c in (f"{x}.p", f"{x}.p0", f"{y}.p", f"{y}.p0"))
        return F.sum(distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0))

    crossed = both.groupBy("lang", F.col("a.place").alias("place"), F.col("b.place").alias("j")).agg(crossing("a", "b").alias("ahead"), crossing("b", "a").alias("behind"))
    ways = F.explode(F.array(F.struct(F.col("place").alias("i"), F.col("j").alias("j"), F.col("ahead").alias("value")), F.struct(F.col("j").alias("i"), F.col("place").alias("j"), F.col("behind").alias("value"))))
    return [base, *(x.select("lang", ways.alias("way")).select("lang", "way.*") for x in (sums, crossed))]


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    postings = materialise(kept_postings(docs, least), "postings")
    groups = materialise(groups_of(docs, postings), "groups")
    priced = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "place", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")
    )
    base, sums, crossed = _corrections(priced, groups)
    pairs = base.unionByName(sums).unionByName(crossed).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda place, c: groups.select("lang", F.col("place").alias(place), F.col("source").alias(c))
    named = pairs.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(order).alias("rank")
    more = priced.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", rank]
    told = materialise(named.select(*columns("pair")).unionByName(more.select(*columns("term")).filter(F.col("rank") <= top)), "audit")
    discard(postings, groups)
    return told


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


#: Every pair of sources meets every kept term here; nothing is shared with the plan above but the definition.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {terms_sql("text", PATTERN)} AS t
  FROM documents),
words AS (SELECT r, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
langs AS (SELECT l.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + ({PARTS}::HUGEINT * (coalesce(c.c, 0) + 1)) // (s.n + l.v) AS p,
         1 + ({PARTS}::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q
  FROM sums s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
