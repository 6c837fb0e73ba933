"""Frame sequences: PNG folders as a DataFrame, one row a frame, and the catalogues around them."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.text import VIDEO_SUFFIXES, has_video_suffix
from strandloom.sources import frame_source
from strandloom.sources.frame_source import SCHEMA

# Field names of jobs and profiles, kinds of motion, statuses and their changes, preferences.
JOB = "id string, source string, source_kind string, title string, status string, created_at double, updated_at double, error string, analysis string, render string, overrides string, output_dir string, local_path string"
PROFILE = "name string, video_width int, video_height int, region array<int>, mode string, created_at double"
MODES = ("paginated", "scroll_vertical", "scroll_horizontal")
STATUSES = ("new", "ready", "downloading", "queued", "analyzing", "analyzed", "queued_render", "rendering", "rendered", "cancelled", "failed")
JSON_FIELDS = ("analysis", "render", "overrides")
#: Status changes of a job.
TRANSITIONS = {
    "new": {"ready", "downloading", "cancelled"}, "downloading": {"ready", "failed", "cancelled"}, "ready": {"queued", "cancelled"}, "queued": {"analyzing", "cancelled"},
    "analyzing": {"analyzed", "failed", "cancelled"}, "analyzed": {"queued", "queued_render"}, "queued_render": {"rendering", "cancelled"}, "rendering": {"rendered", "failed", "cancelled"},
    "rendered": {"queued", "queued_render"}, "failed": {"queued", "queued_render", "downloading"}, "cancelled": {"queued", "downloading"},
}


def read_frames(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Frames below ``folder/<video_id>/*.png`` in path order; an unreadable image fails the query.

    Numbers come from file names while the scan is planned: no row is shuffled. ``columns`` leaves out what is not needed
    (without ``data`` no image is decoded); ``options`` are those of :mod:`strandloom.sources.frame_source`. The result also has
    ``numbers`` (video_id, frame_idx) and ``headers`` (with height and width), readers of the same frames that decode nothing.
    """
    frame_source.register(spark)
    kinds = dict(c.split() for c in SCHEMA.split(", "))

    def read(names: Sequence[str]) -> DataFrame:
        schema = ", ".join(f"{c} {kinds[c]}" for c in names)
        return spark.read.format(frame_source.FORMAT).schema(schema).options(**options).load(folder)

    frames = read(columns or list(kinds))
    frames.numbers, frames.headers = read(["video_id", "frame_idx"]), read(["video_id", "frame_idx", "height", "width"])
    return frames


def read_frame(spark: SparkSession, folder: str, video: str, index: int) -> DataFrame:
    """One frame of one video, its index forced into range; one file is read."""
    return read_frames(spark, folder, video=video, frame=index)


def write_png(path: Path, bgr: np.ndarray) -> None:
    """A PNG file of an H x W x 3 array, without any imaging library."""
    h, w, _ = bgr.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), bgr[:, :, ::-1].reshape(h, -1)), axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b""))


def admitted(sources: DataFrame, path: str = "path", exists: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Local sources with a known video suffix, and those turned away; ``exists`` names a column that tells whether the file is there."""
    good = F.coalesce(has_video_suffix(F.col(path)), F.lit(False))
    if exists is not None:
        good = good & F.coalesce(F.col(exists), F.lit(False))
    return sources.filter(good), sources.filter(~good)


def with_existence(sources: DataFrame, path: str = "path", name: str = "exists") -> DataFrame:
    """Adds whether each path is a file on the machines that will decode it."""

    def run(batches):
        for rows in batches:
            rows[name] = [bool(p) and Path(p).expanduser().is_file() for p in rows[path]]
            yield rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema)
    return sources.mapInPandas(run, f"{fields}, `{name}` boolean")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a JSON list in file order, from any store that Spark reads; malformed content raises, a missing file is an empty list."""
    from strandloom.sources import store

    if not store.exists(spark, path):
        return spark.createDataFrame([], f"{PROFILE}, position long")
    texts = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in PROFILE.split(', '))}>>", {"mode": "FAILFAST"})
    return texts.select(F.posexplode(listed).alias("position", "p")).select("p.*", F.col("position").cast("long").alias("position"))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Store a profile list in its order as one JSON list; the file is replaced as a whole. For several writers: :class:`strandloom.sources.store.Profiles`."""
    from strandloom.sources import store

    fields = [c for c in profiles.columns if c != "position"]
    one = profiles.groupBy().agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("p")))).alias("l"))
    text = one.select(F.to_json(F.transform("l", lambda x: x["p"]))).first()[0]
    store.write_text(profiles.sparkSession, path, text or "[]", replace=True)


def save_profile(spark: SparkSession, path: str, profile: DataFrame) -> None:
    """Replace a profile by name at the end of the stored list."""
    from strandloom.operators.seq import replace_to_end

    stored = read_profiles(spark, path)
    last = stored.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("position"))
    new = profile.drop("position").withColumn("position", F.lit(last.first()[0]).cast("long"))
    write_profiles(replace_to_end(stored, new.select(*stored.columns), "name").drop("appended"), path)


def _replace_file(path: str, text: str) -> None:
    draft = Path(f"{path}.draft")
    draft.parent.mkdir(parents=True, exist_ok=True)
    draft.write_text(text, encoding="utf-8")
    draft.replace(path)


def valid_profile() -> Column:
    """Whether a profile row may be imported."""
    return (
        F.length("name").between(1, 200) & (F.col("video_width") > 0) & (F.col("video_height") > 0) & (F.size("region") == 4)
        & F.forall("region", lambda x: x.isNotNull()) & F.col("mode").isin(*MODES)
    )


def import_profiles(base: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by name in place; any invalid entry fails the whole import."""
    from strandloom.operators.seq import upsert

    checked = new.withColumn("name", F.when(F.coalesce(valid_profile(), F.lit(False)), F.col("name")).otherwise(F.raise_error(F.lit("invalid profile")).cast("string")))
    return upsert(base, checked, "name", "position").orderBy("place").drop("place")


def preferences(stored: dict, defaults: dict) -> dict:
    """Defaults overlaid by what is stored; unknown keys go."""
    return {k: stored.get(k, v) for k, v in defaults.items()}


def read_preferences(path: str, defaults: dict) -> dict:
    """Stored preferences over the defaults; a missing or corrupt file counts as empty."""
    try:
        stored = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        stored = {}
    return preferences(stored if isinstance(stored, dict) else {}, defaults)


def save_preferences(path: str, changes: dict, defaults: dict) -> dict:
    """Overlay known keys, store and return the result; a corrupt file is written anew."""
    now = read_preferences(path, defaults) | {k: v for k, v in changes.items() if k in defaults}
    _replace_file(path, json.dumps(now, indent=2))
    return now


def encode_json(column: Column, kind: str) -> Column:
    """A stored JSON text, normalised to its fields; null stays null."""
    return F.to_json(F.from_json(column, kind))


def decoded(jobs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Jobs with their JSON fields as structs of the given schemas; null stays null."""
    return jobs.select(*(F.from_json(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in jobs.columns))


def create_jobs(jobs: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Jobs with new rows (source, source_kind, title, status, local_path; those that are missing get defaults), each under an id of its own."""
    given = {f.name for f in new.schema}
    fresh = {"id": F.replace(F.uuid(), F.lit("-"), F.lit("")), "created_at": F.lit(now), "updated_at": F.lit(now), "status": F.lit("new")}
    kinds = dict(jobs.dtypes)
    pick = lambda c: F.col(c) if c in given else fresh.get(c, F.lit(None))
    return jobs.unionByName(new.select(*(pick(c).cast(kinds[c]).alias(c) for c in jobs.columns)))


def delete_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs without those of the given ids; unknown ids change nothing."""
    return jobs.join(ids.select("id"), "id", "left_anti").select(*jobs.columns)


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    """The job of an id, or no row."""
    return jobs.filter(F.col("id") == job_id)


def update_jobs(jobs: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """Partial update by id: null fields of a change leave the job's; updated_at is refreshed; a forbidden status change raises."""
    names = [c for c in jobs.columns if c not in ("id", "updated_at")]
    old, new = jobs.alias("o"), changes.alias("n")
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        allowed = allowed | ((F.col("o.status") == before) & F.col("n.status").isin(*after))
    wrong = F.raise_error(F.concat(F.lit("status cannot change from "), "o.status", F.lit(" to "), "n.status"))
    status = F.when(F.col("n.status").isNull() | (F.col("n.status") == F.col("o.status")), F.col("o.status")).when(allowed, F.col("n.status")).otherwise(wrong.cast("string"))
    fields = [status.alias(c) if c == "status" else F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in changes.columns else F.col(f"o.{c}") for c in names]
    touched = F.when(F.col("n.id").isNotNull(), F.lit(now)).otherwise(F.col("o.updated_at"))
    return old.join(new, F.col("o.id") == F.col("n.id"), "left").select("o.id", *fields, touched.alias("updated_at")).select(*jobs.columns)


__all__ = [
    "SCHEMA", "VIDEO_SUFFIXES", "admitted", "create_jobs", "decoded", "delete_jobs", "encode_json", "import_profiles", "job", "preferences", "read_frame", "read_frames", "read_preferences", "read_profiles",
    "save_preferences", "save_profile", "update_jobs", "valid_profile", "with_existence", "write_png", "write_profiles",
]
