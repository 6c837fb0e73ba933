"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit, over hashed byte n-grams, predicts it.
The decoder adds, for every codeword, the logistic loss of the classifiers' margins against its
bits, and takes the language of least loss; a small lead over the second flags ambiguity.

Training fits a bounded sample: at most ``TRAIN_ROWS`` labelled documents, shared evenly among the
languages and chosen by hash of doc_id. The driver gets their fixed-width n-gram vectors, never
texts. Prediction reads whole texts and nothing else.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing is labelled. Very long texts are read in whole, as counts of hashed features; languages that tie go to the first in
order and are flagged by a low score; repeated rows are predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import documents, utf8_view

TRAIN_ROWS = 2000
#: Buckets for pairs and for triples of letters.
PAIRS, TRIPLES = 1024, 3072
WIDTH = PAIRS + TRIPLES
BLOCK_ROWS, BLOCK_BYTES = 256, 2_000_000
#: Lead in probability under which a prediction is ambiguous.
LEAD = 0.2

_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 101


def ngram_vectors(column: pa.Array):
    """Yield (first row, matrix): square roots of n-gram frequencies of whole texts, a row each."""
    data, offsets = utf8_view(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, start + 1), start + BLOCK_ROWS, n)
        rows = end - start
        own = offsets[start : end + 1]
        here = _CLASS[data[own[0] : own[-1]]]
        bounds = own - own[0]
        full = bounds[1:] > bounds[:-1]
        before, after = np.zeros_like(here), np.zeros_like(here)
        before[1:], after[:-1] = here[:-1], here[1:]
        before[bounds[:-1][full]] = 0
        after[bounds[1:][full] - 1] = 0
        owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds))
        letter = here != 0
        here, before, after, owner = here[letter], before[letter], after[letter], owner[letter]
        pair = ((before * np.uint32(128) + here) * np.uint32(2654435761)) >> np.uint32(22)
        triple = (((before * np.uint32(128) + here) * np.uint32(128) + after) * np.uint32(2246822519)) >> np.uint32(8)
        counts = np.zeros((rows, WIDTH), np.float32)
        counts[:, :PAIRS] = np.bincount(owner * PAIRS + pair, minlength=rows * PAIRS).reshape(rows, PAIRS)
        counts[:, PAIRS:] = np.bincount(owner * TRIPLES + triple % TRIPLES, minlength=rows * TRIPLES).reshape(rows, TRIPLES)
        total = np.maximum(counts[:, :PAIRS].sum(axis=1, keepdims=True), 1)
        yield start, np.sqrt(counts / total)
        start = end


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1. Exhaustive up to 7 languages, else the most distant of seeded draws."""
    if k == 1:
        return np.ones((1, 1), np.float32)
    if k <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(columns, np.float32).T
    bits, rng, best = 10 * int(np.ceil(np.log2(k))), np.random.default_rng(11), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(k)).min()
        spread = apart if (np.abs(code.sum(axis=0)) < k).all() else -1
        best = max(best, (spread, code), key=lambda x: x[0])
    return best[1]


def fit(vectors: np.ndarray, labels: np.ndarray, code: np.ndarray, rounds: int = 150, rate: float = 8.0, decay: float = 1e-4):
    """Weights and biases of all bits by accelerated gradient descent on the balanced logistic loss."""
    target = code[labels]
    weight = (1.0 / np.maximum(np.bincount(labels, minlength=len(code)), 1))[labels][:, None].astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((vectors.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b = w, b
    for step in range(rounds):
        margin = vectors @ ahead_w + ahead_b
        slope = -weight * target / (1 + np.exp(np.clip(target * margin, -30, 30)))
        new_w, new_b = ahead_w - rate * (vectors.T @ slope + decay * ahead_w), ahead_b - rate * slope.sum(axis=0)
        pull = step / (step + 3)
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return w, b


def decode(margin: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its probability, and whether the second comes close."""
    loss = np.logaddexp(0, -margin[:, None, :] * code[None]).sum(axis=2)
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    ordered = np.sort(p, axis=1)
    second = ordered[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return best, ordered[:, -1], ordered[:, -1] - second < LEAD


def held_out() -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS):
    """(languages, codewords, weights, biases), or None if no document is labelled."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {x["lang"]: x["n"] for x in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(rows).collect()}
    if not counts:
        return None
    languages, quota = sorted(counts), max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1 << 30, (1 << 30) * quota // n + 1))) for k, n in counts.items()])
    sample = usable.filter(draw < share).select("text", "lang", draw.alias("draw"), "doc_id").orderBy("draw", "doc_id", "lang").limit(rows)

    def run(batches):
        for batch in batches:
            for start, matrix in ngram_vectors(batch.column("text")):
                vectors = pa.array([v.tobytes() for v in matrix], pa.binary())
                cut = batch.slice(start, len(matrix))
                yield pa.RecordBatch.from_pydict({"lang": cut.column("lang"), "draw": cut.column("draw"), "doc_id": cut.column("doc_id"), "v": vectors})

    got = sample.mapInArrow(run, T.StructType.fromDDL("lang string, draw long, doc_id long, v binary")).collect()
    got.sort(key=lambda x: (x["draw"], x["doc_id"] or 0, x["lang"]))
    vectors = np.stack([np.frombuffer(x["v"], np.float32) for x in got])
    labels = np.array([languages.index(x["lang"]) for x in got])
    code = codewords(len(languages))
    return languages, code, *fit(vectors, labels, code)


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every whole text."""
    schema = T.StructType.fromDDL("doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            best, score, close = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if model is not None:
                _, code, w, b = model
                for start, matrix in ngram_vectors(batch.column("text")):
                    at = slice(start, start + len(matrix))
                    best[at], score[at], close[at] = decode(matrix @ w + b, code)
                    for i in np.flatnonzero(~matrix.any(axis=1)):
                        best[start + i] = -1
                for i in np.flatnonzero(best >= 0):
                    # only texts without an ASCII letter need a closer look
                    if not has_letter(batch.column("text")[int(i)].as_py()):
                        best[i] = -1
            none = best < 0
            score[none], close[none] = 0.0, False
            names = ["und" if k < 0 else model[0][k] for k in best]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(score, pa.float64()), "ambiguous": pa.array(close),
            })

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return predict(docs, train(docs))
