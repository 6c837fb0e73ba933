"""Ranked lexical search: the k best documents of each query, by an impact-ordered index of document blocks.

A document's score is a sum over the query's terms of whole-number impacts w * ((10**9 * tf) div (1000 * tf + 12 * m)):
w from the term's document count, m from the document's length. Statistics cover all documents.

Method: score at a time. Each task indexes its documents block by block. The postings of a term are grouped by exact
impact, and the groups are processed in descending order of impact over all terms of a query. What the unprocessed
groups could still add to any document is known from the head of each term. Processing stops only when, by this
bound, no more than ``OPEN`` documents can reach the k-th best score seen so far; their scores are then completed from
the documents' own postings. Scores of processed groups are lower bounds, so that the k-th of them is one too, and the k
best of earlier blocks of the task count as well: a block whose heads sum to less is left at once.

At scale: documents are read twice (statistics, search) and never shuffled. A task ships its k best documents of a
query, and a window with a limit picks k of them. Tasks hold one block: ``POSTINGS`` postings of query terms or
``ROWS`` documents. Queries are taken in blocks of about ``QUERY_BYTES`` of text, whose terms and weights reach the
tasks with the function; each further block is a further pass over the documents.

Defined results: null or empty texts have no terms and are never found, as queries they find nothing; very long texts are
split piece by piece; equal scores rank by ascending doc_id, null last; repeated rows, of documents or queries, are
rows of their own; without documents or queries there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import discard, documents, materialise
from strandloom.llm.terms import folding, pieces, terms, terms_sql

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Postings and documents of a block.
POSTINGS, ROWS = 1_000_000, 50_000
#: Documents whose scores are completed one by one.
OPEN = 256
#: Text of the queries that one pass answers, on average.
QUERY_BYTES = 4_000_000
#: Terms of the document counts that a task combines before it ships them.
HELD = 400_000
_TABLE = folding("0123456789")


def statistics(docs: DataFrame) -> DataFrame:
    """(term, docs, words): documents that hold a term; the row without a term counts documents with any, and all terms."""
    schema = T.StructType.fromDDL("term string, docs bigint, words bigint")

    def shipped(counts: Counter):
        names = list(counts)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(part, pa.binary()).cast(pa.string()), "docs": pa.array([counts[t] for t in part], pa.int64()), "words": pa.nulls(len(part), pa.int64()),
            })

    def run(batches):
        counts, known, total = Counter(), 0, 0
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                own = set()
                for words in pieces(raw, _TABLE):
                    own.update(words)
                    total += len(words)
                counts.update(own)
                known += bool(own)
                if len(counts) >= HELD:
                    yield from shipped(counts)
                    counts = Counter()
        yield from shipped(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.nulls(1, pa.string()), "docs": pa.array([known], pa.int64()), "words": pa.array([total], pa.int64())})

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select(raw).mapInArrow(run, schema).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


class Block:
    """Postings of a block of documents, by document and by term in descending order of impact."""

    def __init__(self, ids, lengths: list[int], owner: list[int], term: list[int], tf: list[int], weight: np.ndarray, n_docs: int, n_words: int):
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        norm = np.array([75 + 25 * n * n_docs // n_words for n in lengths], np.int64)
        self.own, self.term, tf = np.array(owner, np.int64), np.array(term, np.int64), np.array(tf, np.int64)
        self.gain = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[self.own]))
        self.bounds = np.searchsorted(self.own, np.arange(len(lengths) + 1))
        order = np.lexsort((-self.gain, self.term))
        self.docs, self.fall = self.own[order], -self.gain[order]
        self.heads = np.searchsorted(self.term[order], np.arange(len(weight) + 1))

    def complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents; ``wanted`` holds each term's repeats in the query."""
        first, size = self.bounds[docs], np.diff(self.bounds)[docs]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, np.repeat(np.arange(len(docs)), size), wanted[self.term[at]] * self.gain[at])
        return total

    def best(self, query: np.ndarray, repeats: np.ndarray, wanted: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, given that k documents elsewhere score ``least`` or more (0: unknown), and their scores."""
        at, end = self.heads[query].copy(), self.heads[query + 1]
        score = np.zeros(len(self.bounds) - 1, np.int64)
        level = None
        while True:
            left = at < end
            head = np.zeros(len(query), np.int64)
            head[left] = repeats[left] * -self.fall[at[left]]
            rest = int(head.sum())
            if rest < least or rest == 0 or (level is not None and rest <= score.max()):
                reached = max(least, int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0)
                candidates = np.flatnonzero(score + rest >= max(reached, 1))
                if rest == 0 or (rest < reached and len(candidates) <= OPEN):
                    return candidates, score[candidates] if rest == 0 else self.complete(candidates, wanted)
            # the next groups: all impacts from half of the largest head on
            level = max(1, int(head.max()) // 2)
            for i in np.flatnonzero(head >= level):
                stop = at[i] + int(np.searchsorted(self.fall[at[i] : end[i]], -level // int(repeats[i]), side="right"))
                score[self.docs[at[i] : stop]] -= repeats[i] * self.fall[at[i] : stop]
                at[i] = stop


def _merged(held, block: Block, docs: np.ndarray, scores: np.ndarray, k: int):
    """The k best of those held (score, null, id) and of a block's documents."""
    good = scores > 0
    score = np.concatenate((held[0], scores[good]))
    null, ids = np.concatenate((held[1], block.null[docs[good]])), np.concatenate((held[2], block.ids[docs[good]]))
    order = np.lexsort((ids, null, -score))[:k]
    return score[order], null[order], ids[order]


def _pass(docs: DataFrame, block_no: int, queries: list[tuple], weights: dict[bytes, int], n_docs: int, n_words: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): the k best documents of each task for one block of queries."""
    vocabulary = {t: i for i, t in enumerate(weights)}
    weight = np.array(list(weights.values()), np.int64)
    asked = []
    for item, words in queries:
        counts = Counter(vocabulary[w] for w in words if w in vocabulary)
        asked.append((item, np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))
    schema = T.StructType.fromDDL("query bigint, item_id bigint, doc_id bigint, score bigint")

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(asked)
        wanted = np.zeros(len(weight), np.int64)

        def search(*gathered):
            block = Block(*gathered, weight, n_docs, n_words)
            for i, (_, query, repeats) in enumerate(asked):
                if len(query):
                    wanted[query] = repeats
                    least = int(held[i][0][-1]) if len(held[i][0]) >= k else 0
                    held[i] = _merged(held[i], block, *block.best(query, repeats, wanted, k, least), k)
                    wanted[query] = 0

        ids, lengths, owner, term, tf = [], [], [], [], []
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                counts, n = Counter(), 0
                for words in pieces(raw, _TABLE):
                    counts.update(words)
                    n += len(words)
                found = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                if not found:
                    continue
                term += [t for t, _ in found]
                tf += [c for _, c in found]
                owner += [len(ids)] * len(found)
                ids.append(doc)
                lengths.append(n)
                if len(term) >= POSTINGS or len(ids) >= ROWS:
                    search(ids, lengths, owner, term, tf)
                    ids, lengths, owner, term, tf = [], [], [], [], []
        if ids:
            search(ids, lengths, owner, term, tf)
        for i, (score, null, doc) in enumerate(held):
            if len(score):
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array(np.full(len(score), (block_no << 32) + i)), "item_id": pa.array([asked[i][0]] * len(score), pa.int64()),
                    "doc_id": pa.array(doc, mask=null), "score": pa.array(score),
                })

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select("doc_id", raw).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    counts = materialise(statistics(docs), "document-counts")
    whole = counts.filter("term IS NULL").first()
    n_docs, n_words = (whole["docs"], whole["words"]) if whole else (0, 0)
    asked = items.select("item_id", terms(F.col("text"), PATTERN).alias("words"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("item_id", "text").alias("h"))
    size = asked.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("docs") + 1).cast("double"))).cast("long").alias("w")
    parts = []
    for b in range(blocks):
        own = asked.filter(F.pmod("h", F.lit(blocks)) == b)
        used = own.select(F.explode("words").alias("term")).distinct()
        weights = {r.term.encode(): r.w for r in counts.join(used, "term").select("term", weight).collect()}
        queries = [(r.item_id, [w.encode() for w in r.words]) for r in own.select("item_id", "words").collect()]
        parts.append(_pass(docs, b, queries, weights, n_docs, max(n_words, 1), k))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    discard(counts)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every document's whole score for every item that shares a term.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms_sql("text", PATTERN)} AS t FROM documents),
n AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), whole),
m AS (SELECT r, doc_id, 75 + ((25 * n * docs) // words) AS m FROM n, whole),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms_sql("text", PATTERN)}) AS term FROM benchmark) GROUP BY i, item_id, term),
s AS (
  SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= {TOP}
"""
