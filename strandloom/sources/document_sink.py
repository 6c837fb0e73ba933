"""Files from rows (name, content) by a two-step commit: ``docs.write.format("document_files").mode("append").save(folder)``.

Tasks write drafts into a folder of their own job below the target, which is made while the job is planned; a task that still
runs when an abort has removed it fails there. The commit, which runs once all tasks are done, publishes
the drafts of the attempts that count and removes the rest; an abort removes all. So a task that fails, is tried again or
runs twice publishes nothing by itself, and a failed job leaves nothing. A name that exists already, or that two rows have,
fails the job before anything is published (:func:`strandloom.plans.transcribe.free_names` makes names free).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from strandloom.sources.frame_source import located
from strandloom.stored import ready

FORMAT = "document_files"


@dataclass
class Drafts(WriterCommitMessage):
    """(name, draft) of each file of a task."""

    files: tuple[tuple[str, str], ...]


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def folders(self) -> tuple[pafs.FileSystem, str, str]:
        store, folder = located(self.path)
        return store, folder, f"{folder}/.drafts-{self.job}"

    def prepare(self) -> DocumentWriter:
        store, _, drafts = self.folders()
        store.create_dir(drafts, recursive=True)
        return self

    def write(self, iterator: Iterator[Row]) -> Drafts:
        store, _, drafts = self.folders()
        written = []
        for row in iterator:
            if not row["name"] or "/" in row["name"] or row["name"].startswith("."):
                raise ValueError(f"no name of a document: {row['name']!r}")
            draft = f"{drafts}/{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(bytes(row["content"]))
            written.append((row["name"], draft))
        return Drafts(tuple(written))

    def commit(self, messages: list[Drafts | None]) -> None:
        store, folder, drafts = self.folders()
        files = [f for m in messages if m is not None for f in m.files]
        twice = [n for n, c in Counter(n for n, _ in files).items() if c > 1]
        there = [i.base_name for i in store.get_file_info([f"{folder}/{n}" for n, _ in files]) if i.type != pafs.FileType.NotFound]
        if twice or there:
            raise ValueError(f"names that are not free: {sorted({*twice, *there})[:5]}")
        done = []
        try:
            for name, draft in files:
                store.move(draft, f"{folder}/{name}")
                done.append(name)
        except Exception:
            for name in done:
                store.delete_file(f"{folder}/{name}")
            raise
        self.clear(store, drafts)

    def abort(self, messages: list[Drafts | None]) -> None:
        store, _, drafts = self.folders()
        self.clear(store, drafts)

    @staticmethod
    def clear(store: pafs.FileSystem, drafts: str) -> None:
        for left in range(9, -1, -1):  # a task that is being stopped may add a draft meanwhile
            try:
                if store.get_file_info(drafts).type != pafs.FileType.NotFound:
                    store.delete_dir(drafts)
                return
            except OSError:
                if not left:
                    raise


class DocumentFiles(DataSource):
    """A folder of files, one a row."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if overwrite:
            raise ValueError("documents are only appended")
        if not {"name", "content"} <= {f.name for f in schema.fields}:
            raise ValueError("documents need a name and a content")
        return DocumentWriter(self.options["path"]).prepare()


def write(docs: DataFrame, folder: str) -> None:
    """Publish (name, content) rows as files of a folder: all of them or none."""
    spark: SparkSession = docs.sparkSession
    ready(spark)
    spark.dataSource.register(DocumentFiles)
    docs.select("name", "content").write.format(FORMAT).mode("append").save(folder)
