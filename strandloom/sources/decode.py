"""Decoding videos to PNG folders, and reading downloader metadata. Needs ffmpeg on the machines that decode."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import seq

RATE, MOST_HEIGHT = 2, 1080
PROGRAMS = ("ffmpeg", "ffprobe", "tesseract")
FORMATS = "title string, duration double, formats array<struct<format_id:string,ext:string,height:int,fps:double,vcodec:string,filesize:long,filesize_approx:long>>"


def missing_programs() -> list[str]:
    return [p for p in PROGRAMS if shutil.which(p) is None]


def _probe(path: str, entries: str) -> str:
    call = ["ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", entries, "-of", "csv=p=0", path]
    return subprocess.run(call, check=True, capture_output=True, text=True).stdout.strip()


def resolution(path: str) -> tuple[int, int]:
    width, height = _probe(path, "stream=width,height").split(",")[:2]
    return int(width), int(height)


def seconds(path: str) -> float:
    """Duration; 0 where it cannot be read."""
    try:
        return float(_probe(path, "format=duration"))
    except (ValueError, OSError, subprocess.CalledProcessError):
        return 0.0


def progress(lines: Iterator[str], total: float) -> Iterator[float]:
    """Shares done from key=value lines, at most 1; with an unknown total only the final 1."""
    for line in lines:
        key, _, value = line.strip().partition("=")
        if key in ("out_time_us", "out_time_ms") and total > 0 and value.lstrip("-").isdigit():
            yield min(1.0, max(0.0, int(value) / 1e6 / total))
        elif key == "progress" and value == "end":
            yield 1.0


def extract(path: str, folder: str, rate: float = RATE, tell: Callable[[float], None] | None = None) -> list[str]:
    """PNG frames in order; frames that are there already are taken as they are. Heights over 1080 are scaled down."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    if not (done := sorted(map(str, target.glob("frame_*.png")))):
        steps = [f"fps={rate}"] + [f"scale=-2:{MOST_HEIGHT}"] * (resolution(path)[1] > MOST_HEIGHT)
        call = ["ffmpeg", "-v", "error", "-progress", "pipe:1", "-i", path, "-vf", ",".join(steps), str(target / "frame_%06d.png")]
        with subprocess.Popen(call, stdout=subprocess.PIPE, text=True) as run:
            for share in progress(run.stdout, seconds(path)):
                if tell:
                    tell(share)
        if run.returncode:
            raise RuntimeError(f"{path} could not be decoded")
        done = sorted(map(str, target.glob("frame_*.png")))
    return done


def decode_all(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """(video_id, frames): decode (path, folder) pairs, one task each; folders must be shared by all executors."""
    jobs = spark.createDataFrame(sources, "path string, folder string").repartition(max(1, len(sources)))

    def run(batches):
        for pdf in batches:
            pdf["frames"] = [len(extract(p, f)) for p, f in zip(pdf["path"], pdf["folder"], strict=True)]
            pdf["video_id"] = pdf["folder"].map(lambda f: Path(f).name)
            yield pdf[["video_id", "frames"]]

    return jobs.mapInPandas(run, "video_id string, frames long")


def with_video(codec: Column) -> Column:
    """Whether a format has a picture: its codec is told and is not none."""
    return F.coalesce(codec, F.lit("none")) != "none"


def best_formats(metadata: DataFrame, column: str = "json") -> DataFrame:
    """One video format per height from downloader JSON, best first: no audio-only ones, by height and rate, ties in listed order."""
    info = metadata.withColumn("info", F.from_json(column, FORMATS))
    each = info.select("id", "info.title", F.coalesce("info.duration", F.lit(0.0)).alias("duration"), F.posexplode("info.formats").alias("pos", "f"))
    video = each.filter(with_video(F.col("f.vcodec")))
    order: list[Column] = [F.coalesce("f.height", F.lit(0)).desc(), F.coalesce("f.fps", F.lit(0.0)).desc(), F.col("pos")]
    kept = seq.best_first(video, ["id"], ["f.height"], order)
    size = F.coalesce("f.filesize", "f.filesize_approx").alias("size")
    return kept.select("id", "title", "duration", "rank", "f.format_id", "f.ext", "f.height", "f.fps", size)
