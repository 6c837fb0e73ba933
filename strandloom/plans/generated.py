"""Frames and canvases drawn from table rows, whose regions, cursors, offsets, blocks and barlines are known by construction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import pixels as px
from strandloom.operators import folds, video
from strandloom.sources.frames import SCHEMA
from strandloom.stored import ready

STRIP = (10, 10, 170, 70)


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """One number a nation."""
    return spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_nationkey").alias("n"))


def frames(rows: DataFrame, draw) -> DataFrame:
    """Frames of the images ``draw(n)`` of each row, as video ``v<n>``."""

    def run(batches):
        for batch in batches:
            for n in batch["n"]:
                yield pd.DataFrame([(f"v{n}", i, *m.shape[:2], np.ascontiguousarray(m).tobytes()) for i, m in enumerate(draw(int(n)))], columns=["video_id", "frame_idx", "height", "width", "data"])

    ready(rows.sparkSession)
    return rows.mapInPandas(run, SCHEMA)


def canvases(rows: DataFrame, schema: str, look) -> DataFrame:
    """Rows of ``look(n)`` for each number."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(int(n), *row) for n in batch["n"] for row in look(int(n))], columns=names)

    ready(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def _lined(height: int, width: int, lines: int, gap: int, top: int) -> np.ndarray:
    g = np.full((height, width), 255, np.uint8)
    for k in range(lines):
        g[top + k * gap : top + k * gap + 2] = 120
    return g


def _on_dark(paper: np.ndarray, x0: int, y0: int, size: tuple[int, int]) -> np.ndarray:
    image = np.full((*size, 3), 60, np.uint8)
    image[y0 : y0 + paper.shape[0], x0 : x0 + paper.shape[1]] = paper[..., None] if paper.ndim == 2 else paper
    return image


def papers(n: int) -> list[np.ndarray]:
    """Five frames of a sheet of 90 rows with 4 to 6 light lines, a dark one and a short one, which count for nothing. The fourth
    frame is off by less than 3 % of the frame's larger side, the last by more."""
    wide = n % 5 == 0
    width, size, near, far = (820, (150, 900), 20, 40) if wide else (120, (150, 200), 5, 10)
    sheet = np.full((90, width), 255, np.uint8)
    for k in range(4 + n % 3):
        sheet[10 + k * 12 : 12 + k * 12] = 180
    sheet[4:6, : width * 45 // 100] = 180
    sheet[80:82] = 120
    return [_on_dark(sheet, 20 + n + off, 16 + n, size) for off in (0, 0, 0, near, far)]


def regions(spark: SparkSession, folder: str) -> DataFrame:
    found = video.detect_region(frames(keys(spark, folder), papers))
    return found.select("video_id", *video.EDGES, "confidence", "n_lines", "low_res_warning")


def marked(n: int) -> list[np.ndarray]:
    """Four frames with a red bar that goes right, and one without."""
    out = []
    for k in range(4):
        strip = np.repeat(_lined(60, 160, 4, 12, 10)[..., None], 3, axis=2)
        strip[5:55, 12 + n + 25 * k : 15 + n + 25 * k] = (0, 0, 255)
        out.append(_on_dark(strip, 10, 10, (90, 190)))
    return [*out, _on_dark(_lined(60, 160, 4, 12, 10), 10, 10, (90, 190))]


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    return video.cursor_track(frames(keys(spark, folder), marked), STRIP).select("video_id", "frame_idx", "x")


def rolled(n: int) -> list[np.ndarray]:
    """Six frames of a strip that goes up by 6 to 10 rows each; where n is 1 more than a multiple of 3, so noisy that no strip matches
    well, though the whole picture still tells the shift."""
    r = np.random.default_rng(n)
    tall = r.integers(64, 192, (60 + 5 * (6 + n % 5), 160)).astype(np.float64)
    blur = 35.0 if n % 3 == 1 else 0.0
    cut = lambda k: np.clip(tall[k * (6 + n % 5) :][:60] + blur * r.normal(0, 1, (60, 160)), 0, 255).astype(np.uint8)
    return [_on_dark(cut(k), 10, 10, (90, 190)) for k in range(6)]


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    return video.scroll_offsets(frames(keys(spark, folder), rolled), STRIP).select("video_id", "frame_idx", "offset", "resolution")


def moved(n: int) -> list[np.ndarray]:
    """Strips of 60 x 160 that go up, go left, or go left by 3 columns in every second pair: under 2 % of their width, over that of their height."""
    r, step = np.random.default_rng(n), 6 + n % 5
    if n % 3 == 0:
        places = [(k * step, 0) for k in range(6)]
    elif n % 3 == 1:
        places = [(0, k * step) for k in range(6)]
    else:
        places = [(0, 3 * (k // 3)) for k in range(18)]
    large = r.integers(0, 256, (60 + places[-1][0], 160 + places[-1][1])).astype(np.uint8)
    return [_on_dark(large[y : y + 60, x : x + 160], 10, 10, (90, 190)) for y, x in places]


def motions(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of motion of strips that go up, left, or left by too little."""
    told = video.classify_advance(frames(keys(spark, folder), moved), STRIP)
    return told.select("video_id", "mode", "axis", *(F.round(c, 0).cast("int").alias(c) for c in ("med_dx", "med_dy")), "n_events")


def flipped(n: int) -> list[np.ndarray]:
    """Pages of 6, 4 and 3 frames and a dark one of 6, a bar going right over each; the first frame of a page lacks its first line."""
    out = []
    for page, size in enumerate((6, 4, 3, 6)):
        for k in range(size):
            strip = np.repeat(_lined(60, 160, 4, 12, 8 + page)[..., None], 3, axis=2)
            if k == 0:
                strip[8 + page : 10 + page] = 255
            strip[5:55, 5 + n % 5 + 28 * k : 8 + n % 5 + 28 * k] = (255, 0, 0)
            out.append(_on_dark(strip if page < 3 else (strip * 0.3).astype(np.uint8), 10, 10, (90, 190)))
    return out


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of flipped strips: contributors, whether they are transitions or of few frames, and the first inked row of the canvas."""
    data = frames(keys(spark, folder), flipped)
    composed = video.compose_pages(video.page_frames(data, video.page_starts(video.cursor_track(data, STRIP))), STRIP)

    def run(batches):
        for batch in batches:
            top = [int(np.argmax((np.frombuffer(r.canvas, np.uint8).reshape(r.height, r.width) < 150).mean(axis=1) > 0.9)) for r in batch.itertuples()]
            yield batch.assign(top=top)[["video_id", "page", "contributors", "transition", "low_confidence", "start", "end", "top"]]

    return composed.mapInPandas(run, "video_id string, page int, contributors int, transition boolean, low_confidence boolean, start int, end int, top int")


def systems(n: int) -> np.ndarray:
    """Two systems of five bars of 10 rows, 5 apart, with margins of 10 and 80 + n rows between them."""
    height = 10 + 70 + 80 + n + 70 + 10
    g = np.full((height, 100), 255, np.uint8)
    for top in (10, 160 + n):
        for k in range(5):
            g[top + 15 * k : top + 15 * k + 10] = 0
    return g


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return canvases(keys(spark, folder), "n int, pos int, top int, bottom int", lambda n: [(i, a, b) for i, (a, b) in enumerate(px.blocks(systems(n))[0])])


def scroll_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same canvases as bands, cut without any task that holds a canvas; bridged where n is odd. Where n is 2 more than a
    multiple of 4, two short strokes cross the cut, and a mark of 120 pixels follows that is no system."""

    def look(n):
        g = systems(n)
        if n % 2:
            g[70 : 170 + n, [30, 60]] = 0
        if n % 4 == 2:
            g[110 + n // 2 : 130 + n // 2, [40, 70]] = 0
            more = np.full((92 + n, 100), 255, np.uint8)
            more[70 + n : 82 + n, 20:30] = 0
            g = np.vstack((g, more))
        return [(f"v{n}", i // video.BAND, 3, False, g.shape[1], g[i : i + video.BAND].tobytes()) for i in range(0, len(g), video.BAND)]

    bands = canvases(keys(spark, folder), "n int, video_id string, band int, contributors int, low_confidence boolean, width int, rows binary", look).drop("n")
    return video.scroll_systems(bands).select("video_id", "pos", "height", "width", "cuts_on_ink", "discarded_ink", F.length("canvas").alias("pixels"))


def _barred(n: int, bars: int = 3) -> np.ndarray:
    g = _lined(120, 300, 4, 12, 40)
    for x in (30 + n, 130 + 2 * n, 250 + n)[:bars]:
        g[40:78, x : x + 3] = 0
    return g


def barlines(spark: SparkSession, folder: str) -> DataFrame:
    return canvases(keys(spark, folder), "n int, pos int, x int", lambda n: list(enumerate(px.barlines(_barred(n)))))


def trims(spark: SparkSession, folder: str) -> DataFrame:
    """Width that is left of a page cut before its last barline, unless it is the last page or would lose too much."""
    look = lambda n: [(g.shape[1], low) for g, low in (px.trim(_barred(n, 1 if n % 4 == 1 else 3), n % 4 == 0),)]
    return canvases(keys(spark, folder), "n int, width int, guarded boolean", look)


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Box of the leftmost group of digit-sized marks: two near ones, not the third, nor one that is too tall."""

    def look(n):
        g = np.full((60, 250), 255, np.uint8)
        g[10:30, 5 + n : 15 + n] = g[12:32, 20 + n : 30 + n] = g[10:30, 90 + n : 100 + n] = g[5:55, 150:160] = 0
        return [px.first_number_box(g)]

    return canvases(keys(spark, folder), "n int, x0 int, y0 int, x1 int, y1 int", look)


def staves(spark: SparkSession, folder: str) -> DataFrame:
    """Staves of a canvas with two of them, 60 + n rows apart."""

    def look(n):
        g = np.vstack((_lined(60, 200, 4, 12, 10), np.full((60 + n, 200), 255, np.uint8), _lined(80, 200, 6, 12, 10)))
        return [(i, s["top"], s["bottom"], s["n_lines"]) for i, s in enumerate(px.staves(g))]

    return canvases(keys(spark, folder), "n int, pos int, top int, bottom int, n_lines int", look)


def layout(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet and place of eight systems of 560 columns and 40 + n rows, scaled four times, on low sheets."""
    look = lambda n: [(f"v{n}", k, 40 + n, 560, bytes([255]) * (560 * (40 + n)), False) for k in range(8)]
    rows = canvases(keys(spark, folder), "n int, video_id string, pos int, height int, width int, canvas binary, low_confidence boolean", look)
    return video.layout(rows.drop("n"), capacity=900).select("video_id", "pos", "height", "width", "sheet", "y")


def songs(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of two songs of 30 + n and 40 frames whose surroundings differ, and a flash of 3 frames between them that is absorbed."""

    def look(n):
        out = []
        for k in range(30 + n + 3 + 40):
            level = 20.0 if k < 30 + n else 250.0 if k < 33 + n else 120.0
            noise = np.random.default_rng(1000 * n + k).normal(0, 0.1, 48)
            out.append((f"v{n}", k, (level + noise).astype(np.float32).tolist()))
        return out

    vectors = canvases(keys(spark, folder), "n int, video_id string, frame_idx int, sig array<float>", look).drop("n")
    return folds.segments(vectors, ["video_id"], ["frame_idx"], "sig")


__all__ = ["barlines", "blocks", "cursors", "frames", "keys", "layout", "motions", "numbers", "offsets", "pages", "regions", "scroll_blocks", "songs", "staves", "trims"]
