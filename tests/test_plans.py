"""What the frame plans may not do: move whole images through an exchange, a sort or a window, or read them too often."""

import re

import numpy as np
import pytest

from strandloom import stored as stores
from strandloom.operators import seq, video
from strandloom.plans import transcribe
from strandloom.sources import frames as src
from tests.shapes import frame, staff

BOX, SIZE = (24, 16, 264, 130), (150, 290)


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def moved_images(text):
    """Operators that shuffle, sort or window rows which hold the column ``data``."""
    out = []
    for part in re.split(r"\n\n+", text):
        head = re.match(r"\(\d+\) (\w+)", part.strip())
        if head and head[1] in ("Exchange", "Sort", "Window", "SortMergeJoin", "BroadcastExchange", "ObjectHashAggregate", "SortAggregate") and re.search(r"Input[^\n]*\bdata#", part):
            out.append(part)
    return out


def scans(text):
    return sum(1 for x in re.findall(r"\(\d+\) (?:BatchScan|Scan) ?[^\n]*", text))


@pytest.fixture
def folder(tmp_path):
    w, h = BOX[2] - BOX[0], BOX[3] - BOX[1]
    long = np.vstack([staff(w, 60, 50 + k, gap=12, top=8) for k in range(8)])
    clips = {
        "flip": [frame(staff(w, h, c, gap=14), cursor=8 + s * 40, region=BOX, size=SIZE) for c in (0, 1) for s in range(6)],
        "roll": [frame(long[(k // 3) * 20 :], region=BOX, size=SIZE) for k in range(18)],
    }
    for name, images in clips.items():
        (tmp_path / name).mkdir()
        for k, image in enumerate(images):
            src.write_png(tmp_path / name / f"{k:04d}.png", image)
    return str(tmp_path)


@pytest.fixture
def kept(monkeypatch):
    """The plans of all tables that are stored meanwhile."""
    seen, whole = [], stores.stored

    def watched(df, name):
        if not getattr(df, "stored_at", None):
            seen.append((name, formatted(df)))
        return whole(df, name)

    for module in (stores, video, transcribe, seq):
        monkeypatch.setattr(module, "stored", watched)
    return seen


def test_frames_stay_where_they_are_read(spark, folder, kept):
    frames = src.read_frames(spark, folder)
    assert not moved_images(formatted(frames)) and scans(formatted(frames)) == 1
    found = video.detect_region(frames)
    assert [n for n, _ in kept] == ["by-key", "candidates"] and scans(formatted(found)) <= 8
    info = transcribe.analyse(frames)
    told = {r.video_id: r for r in info.collect()}
    assert told["flip"]["mode"] == "paginated" and told["roll"]["mode"] == "scroll_vertical"
    planned = len(kept)
    placed, report = transcribe.render_songs(frames, info, transcribe.songs_of(info))
    assert {r.song_id for r in report.collect()} == {"flip#0000", "roll#0000"}
    assert len(kept) > planned
    for name, text in kept:
        assert not moved_images(text), name
        assert len(re.findall(r"^\(\d+\) MapInPandas", text, re.M)) <= 5 and scans(text) <= 8, name
        assert len(re.findall(r"^\(\d+\) BatchScan", text, re.M)) <= 1, name  # images are read once for each stored table
    for df in (info, placed, report):
        assert not moved_images(formatted(df)) and "PythonBatchScan" not in formatted(df)
    # candidates are found once for each call, the pages of all paged songs together
    assert sum(n == "candidates" for n, _ in kept) == 2 and sum(n == "pages" for n, _ in kept) == 1


def test_a_moved_image_is_noticed(spark, folder):
    assert moved_images(formatted(src.read_frames(spark, folder).repartition(3, "video_id")))


def test_pages_of_frames_as_they_are_read(spark, folder):
    """A filter on pages over a join with frames of the data source must see the frame's number."""
    frames = src.read_frames(spark, folder)
    none = spark.createDataFrame([], "video_id string, frame_idx int")
    some = spark.createDataFrame([("flip", 2), ("flip", 7)], "video_id string, frame_idx int")
    for starts, want in ((none, {("flip", 0, 0, 12): 12, ("roll", 0, 0, 18): 18}), (some, {("flip", 0, 2, 5): 5, ("flip", 1, 7, 5): 5, ("roll", 0, 0, 18): 18})):
        got = video.page_frames(frames, starts).groupBy("video_id", "page", "first", "size").count().collect()
        assert {tuple(r)[:4]: r["count"] for r in got} == want
