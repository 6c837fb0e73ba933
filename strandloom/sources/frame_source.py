"""Frame folders as a data source of its own: ``spark.read.format("frame_folder")``.

Partitions are planned from file names: the files of a folder ``<video_id>/*.png`` in path order are the frames 0, 1, 2 and so
on, and a partition is a run of them, so the number of a frame is known in the scan. Only columns of the given schema are
made: without ``data``, ``height`` and ``width`` no file is opened, without ``data`` only its header is read.

Options: ``first`` and ``last`` (frame numbers, both included), ``video`` (one folder), ``frame`` (one number, forced into
range), ``per_partition`` (files). Names that the options rule out are not read. Folders are listed through Arrow's file systems;
a path of a scheme that Arrow does not know raises.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandloom.sources import png
from strandloom.stored import ready

SCHEMA = "video_id string, frame_idx int, height int, width int, data binary"
FORMAT = "frame_folder"
PER_PARTITION = 64
#: Image bytes of a batch.
BATCH_BYTES = 32_000_000
_KINDS = {"video_id": pa.string(), "frame_idx": pa.int32(), "height": pa.int32(), "width": pa.int32(), "data": pa.binary()}


@dataclass
class Run(InputPartition):
    """Neighbouring frames of one video."""

    video: str
    first: int
    paths: tuple[str, ...]


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class FolderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        unknown = set(self.names) - set(_KINDS)
        if unknown:
            raise ValueError(f"no such columns of a frame: {sorted(unknown)}")
        self.options = {k.lower(): v for k, v in options.items()}
        if "path" not in self.options:
            raise ValueError("a folder of frames needs a path")

    def files(self) -> dict[str, list[str]]:
        """Paths of each video in order."""
        store, root = located(self.options["path"])
        only = self.options.get("video")
        found = defaultdict(list)
        for info in store.get_file_info(pafs.FileSelector(f"{root}/{only}" if only else root, recursive=True)):
            if info.type == pafs.FileType.File and info.base_name.lower().endswith(".png"):
                found[info.path.rsplit("/", 2)[-2]].append(info.path)
        return {v: sorted(paths) for v, paths in sorted(found.items())}

    def partitions(self) -> list[Run]:
        per = int(self.options.get("per_partition", PER_PARTITION))
        runs = []
        for video, paths in self.files().items():
            first, last = int(self.options.get("first", 0)), int(self.options.get("last", len(paths) - 1))
            if "frame" in self.options:
                first = last = max(0, min(int(self.options["frame"]), len(paths) - 1))
            runs += [Run(video, at, tuple(paths[at : min(at + per, last + 1)])) for at in range(max(0, first), min(last + 1, len(paths)), per)]
        return runs or [Run("", 0, ())]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.options["path"])
        rows, held = [], 0
        for i, path in enumerate(partition.paths):
            row = {"video_id": partition.video, "frame_idx": partition.first + i}
            if "data" in self.names:
                row["height"], row["width"], row["data"] = self.image(store, path)
                held += len(row["data"])
            elif {"height", "width"} & set(self.names):
                row["height"], row["width"] = self.size(store, path)
            rows.append(row)
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS[c]) for c in self.names], self.names)

    def image(self, store: pafs.FileSystem, path: str) -> tuple[int, int, bytes]:
        with store.open_input_stream(path) as f:
            raw = f.read()
        try:
            image = png.decode(raw)
        except ValueError as wrong:
            raise ValueError(f"unreadable frame {path}: {wrong}") from wrong
        return *image.shape[:2], image.tobytes()

    def size(self, store: pafs.FileSystem, path: str) -> tuple[int, int]:
        with store.open_input_stream(path) as f:
            head = f.read(24)
        if len(head) < 24 or head[12:16] != b"IHDR":
            raise ValueError(f"unreadable frame {path}: not a PNG file")
        return tuple(reversed(struct.unpack(">II", head[16:24])))


class FrameFolder(DataSource):
    """One row a frame of the folders below a path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(FrameFolder)
