"""Small stored tables with versions: snapshots as Parquet, a pointer a version, and a conflict where two writers meet.

A store is a folder on any file system that Hadoop knows: ``data/<id>`` holds a snapshot, ``versions/<number>`` names the
snapshot of a version. A writer reads version n, writes a whole new snapshot and claims the number n + 1. The claim is one
operation that fails if the number is taken, so of two writers with one base one wins, and the other, which has changed nothing,
raises :class:`Conflict` or, by :meth:`Store.update`, does its change again on what the winner wrote. Readers see one whole version.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import seq
from strandloom.sources import frames
from strandloom.stored import hadoop


class Conflict(Exception):
    """The version that a change is based on is not the last one any more."""


def exists(spark: SparkSession, path: str) -> bool:
    files, where = hadoop(spark, path)
    return files.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = hadoop(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    """A whole text under a name, by a draft that is renamed; without ``replace`` false, and nothing changed, where the name is taken."""
    files, where = hadoop(spark, path)
    files.mkdirs(where.getParent())
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    _, at = hadoop(spark, draft)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        if not replace and files.getScheme() == "file":
            # a rename replaces on local disks; a link to a name that is taken fails
            os.link(at.toUri().getPath(), where.toUri().getPath())
        else:
            rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
            ways = spark.sparkContext._gateway.new_array(rename, 1)
            ways[0] = rename.OVERWRITE if replace else rename.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(at, where, ways)
        return True
    except FileExistsError:
        return False
    except Exception as wrong:
        if not replace and "FileAlreadyExists" in str(wrong):
            return False
        raise
    finally:
        files.delete(at, False)


class Store:
    """Versions of one table of a fixed schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _names(self) -> list[str]:
        files, where = hadoop(self.spark, f"{self.path}/versions")
        listed = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(n for n in listed if n.isdigit())

    def version(self) -> int:
        """Number of the last version; 0 for an empty store."""
        return int(max(self._names(), default="0"))

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version, by default of the last one."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{read_text(self.spark, self._pointer(version))}")

    def _pointer(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}"

    def commit(self, rows: DataFrame, base: int) -> int:
        """Store ``rows`` as the version after ``base``; raises Conflict, and leaves nothing, if there is one already."""
        snapshot = uuid.uuid4().hex
        files, where = hadoop(self.spark, f"{self.path}/data/{snapshot}")
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(str(where))
        if not write_text(self.spark, self._pointer(base + 1), snapshot, replace=False):
            files.delete(where, True)
            raise Conflict(f"version {base + 1} of {self.path} was written by another")
        return base + 1

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Apply a change to the last version and store the result; where another writer was faster, on what that one wrote."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.commit(change(self.read(base)), base)
            except Conflict:
                continue
        raise Conflict(f"{self.path} changed {tries} times meanwhile")

    def clear_old(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions."""
        for name in self._names()[: -max(1, keep)]:
            snapshot = read_text(self.spark, f"{self.path}/versions/{name}")
            for old in (f"versions/{name}", f"data/{snapshot}"):
                files, where = hadoop(self.spark, f"{self.path}/{old}")
                files.delete(where, True)


class Jobs(Store):
    """Stored job rows."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, frames.JOB)

    def create(self, new: DataFrame, now: float) -> int:
        return self.update(lambda jobs: frames.create_jobs(jobs, new, now))

    def change(self, changes: DataFrame, now: float) -> int:
        """Partial update by id; a forbidden change of status raises, also where another writer changed the status first."""
        return self.update(lambda jobs: frames.update_jobs(jobs, changes, now))

    def delete(self, ids: DataFrame) -> int:
        return self.update(lambda jobs: frames.delete_jobs(jobs, ids))

    def get(self, job_id: str) -> DataFrame:
        return frames.job(self.read(), job_id)

    def recent(self, n: int) -> DataFrame:
        return seq.recent(self.read(), "created_at", "id", n)


class Profiles(Store):
    """Stored profiles in their order."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, f"{frames.PROFILE}, position long")

    def save(self, profile: DataFrame) -> int:
        """Replace a profile by name at the end."""

        def change(stored: DataFrame) -> DataFrame:
            last = stored.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("position"))
            new = profile.drop("position").crossJoin(F.broadcast(last))  # one row
            return seq.replace_to_end(stored, new.select(*stored.columns), "name").drop("appended")

        return self.update(change)

    def load(self, new: DataFrame) -> int:
        """Import profiles: replace by name in place, new ones follow; any invalid one fails the whole import."""

        def change(stored: DataFrame) -> DataFrame:
            placed = frames.import_profiles(stored, new)
            return placed.select("*", F.monotonically_increasing_id().alias("position"))

        return self.update(change)
