"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes the documents that its predecessor kept, as Parquet, and its decisions take
effect: rejected documents and further copies go, personal data are replaced, sources are mixed
(a document taken n times has n rows), and the last stage returns token ids of what is left.

Defined results: a null, empty or blank text fails the first stage; very long texts pass through every stage in whole; rows of one
doc_id with unlike texts are documents of their own, repeated rows are near duplicates of each other, of which one stays; null
languages get no verdict from the stop-word rule, null sources are mixed as one source; an empty table gives no rows; extra
columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, minhash, mixing, pii, quality_rules
from strandloom.llm.common import documents, materialise, ready


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    ready(spark)
    return minhash.keep_one(docs, 5)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data."""
    return pii.pseudonymise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.apply(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of ids and decoded text."""
    ready(spark)
    return bpe.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", filter_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: Hashed draws and a byte-pair codec are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
