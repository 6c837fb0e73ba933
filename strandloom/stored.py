"""Tables kept for the length of a session, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored bytes up to which a table of one row a video is broadcast; beyond it joins are left to the planner.
SMALL = 8_000_000


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own path."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; own only in local mode."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='strandloom-')}")
    return context.getCheckpointDir()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared folder: every later reader sees the same rows, and a lost executor costs a re-read."""
    if getattr(frame, "stored_at", None):
        return frame
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    files, where = hadoop(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at, out.stored_bytes = path, files.getContentSummary(where).getLength()
    return out


def with_rows_of(frames: DataFrame, table: DataFrame, key: str | list[str] = "video_id", how: str = "inner") -> DataFrame:
    """Frames with the columns of a table of few rows a key. The table is stored first; its size decides whether it is
    broadcast, so that images stay where they are read."""
    table = stored(table, "by-key")
    return frames.join(F.broadcast(table) if table.stored_bytes <= SMALL else table, key, how)
