"""Shared pieces: table reading, durable intermediate tables, and numpy text primitives."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Word separators of every contract: space and U+0009 to U+000D. Java and RE2 read this alike.
WORD_BREAK = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own path."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; own only in local mode."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='strandloom-')}"
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a stored table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and read it back, so that lineage ends there.

    A lost executor then costs a re-read of files, not a recomputation, and every
    later reader sees the same rows. The table goes with :func:`discard`, or when the session's
    process ends.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that no later step reads."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            files, where = _files(table.sparkSession, path)
            files.delete(where, True)


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows, without copying text. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, elementwise over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
