import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.plans import transcribe
from strandloom.sources import document_sink, frame_source, png
from strandloom.sources import frames as src


def encode(image, colour, filters, palette=None):
    """A PNG file of samples (H x W x n) with the given filter of each row."""
    h, w, n = image.shape
    x = image.astype(np.int64)
    rows = []
    for y in range(h):
        kind = filters[y % len(filters)]
        a = np.vstack((np.zeros((1, n), np.int64), x[y, :-1]))
        b = x[y - 1] if y else np.zeros((w, n), np.int64)
        c = np.vstack((np.zeros((1, n), np.int64), b[:-1]))
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        guess = [0 * a, a, b, (a + b) // 2, np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))][kind]
        rows.append(bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(b"".join(rows))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))] + ([chunk(b"PLTE", palette.tobytes())] if palette is not None else [])
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + chunk(b"IDAT", body[:20]) + chunk(b"IDAT", body[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4], [2, 2, 4, 1]])
def test_png_filters_and_colours(filters):
    r = np.random.default_rng(len(filters))
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        image = r.integers(0, 256, (13, 17, n)).astype(np.uint8)
        want = image[..., 2::-1] if n >= 3 else np.repeat(image[..., :1], 3, axis=2)
        assert (png.decode(encode(image, colour, filters)) == want).all()
    table, image = r.integers(0, 256, (5, 3)).astype(np.uint8), r.integers(0, 5, (4, 6, 1)).astype(np.uint8)
    assert (png.decode(encode(image, 3, filters, table)) == table[image[..., 0]][..., ::-1]).all()


@pytest.mark.parametrize("raw", [b"", b"no image", encode(np.zeros((2, 2, 3), np.uint8), 2, [0])[:-14], encode(np.zeros((2, 2, 3), np.uint8), 2, [0])[:45], encode(np.zeros((2, 2, 4), np.uint8), 2, [0])])
def test_damaged_png(raw):
    with pytest.raises(ValueError):
        png.decode(raw)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("frames")
    for v, n in (("b", 150), ("a", 3)):
        (root / v).mkdir()
        for k in range(n):
            src.write_png(root / v / f"frame_{k + 1:06d}.png", np.full((4, 6, 3), k % 256, np.uint8))
    (root / "a" / "notes.txt").write_text("no frame")
    return root


def plan(df):
    return df._jdf.queryExecution().toString()


def test_frames_are_numbered_in_the_scan(spark, folder):
    frames = src.read_frames(spark, str(folder))
    assert frames.rdd.getNumPartitions() == 4  # 3 runs of at most 64 files of b, one of a
    assert not any(x in plan(frames) for x in ("Window", "Exchange", "Sort"))
    rows = frames.collect()
    assert sorted((r.video_id, r.frame_idx) for r in rows) == [("a", k) for k in range(3)] + [("b", k) for k in range(150)]
    assert all((r.height, r.width) == (4, 6) and bytes(r.data) == bytes([r.frame_idx]) * 72 for r in rows)
    assert src.read_frames(spark, f"file://{folder}").count() == 153
    part = src.read_frames(spark, str(folder), first=2, last=4)
    assert sorted((r.video_id, r.frame_idx) for r in part.collect()) == [("a", 2), ("b", 2), ("b", 3), ("b", 4)]


def test_only_asked_columns_and_frames_are_read(spark, folder, tmp_path):
    (tmp_path / "v").mkdir()
    src.write_png(tmp_path / "v" / "1.png", np.zeros((5, 7, 3), np.uint8))
    (tmp_path / "v" / "2.png").write_bytes((tmp_path / "v" / "1.png").read_bytes()[:40])  # a header without an image
    (tmp_path / "v" / "3.png").write_bytes(b"")
    read = lambda *columns, **more: src.read_frames(spark, str(tmp_path), columns or None, **more)
    assert sorted(r.frame_idx for r in read("video_id", "frame_idx").collect()) == [0, 1, 2]
    assert [tuple(r) for r in read("width", "height", last=1).collect()] == [(7, 5)] * 2
    assert src.read_frame(spark, str(tmp_path), "v", -5).collect()[0].data == bytes(105)  # the other files are damaged
    for more, name in ((dict(frame=1), "2.png"), (dict(frame=99), "3.png")):
        with pytest.raises(Exception, match=f"unreadable frame .*{name}"):
            read(**more).collect()
    one = src.read_frame(spark, str(folder), "b", 140)
    assert one.rdd.getNumPartitions() == 1 and [r.frame_idx for r in one.collect()] == [140]
    (tmp_path / "none").mkdir()
    assert src.read_frames(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format(frame_source.FORMAT).schema("colour int").load(str(folder)).collect()


def names(path):
    return sorted(p.name for p in path.rglob("*"))


def test_documents_appear_together_or_not_at_all(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i:02d}.pdf", bytes([i]) * 10) for i in range(20)], "name string, content binary").repartition(5)
    out = tmp_path / "out"
    paths = sorted(r.path for r in transcribe.write_documents(docs, str(out)).collect())
    assert paths == [f"{out}/{i:02d}.pdf" for i in range(20)] and names(out) == [f"{i:02d}.pdf" for i in range(20)]
    assert (out / "07.pdf").read_bytes() == bytes([7]) * 10
    bad = docs.withColumn("content", F.when(F.col("name") == "13.pdf", F.raise_error(F.lit("torn")).cast("binary")).otherwise(F.col("content")))
    for frame, folder, why in ((bad, tmp_path / "torn", "torn"), (docs, out, "not free"), (docs.union(docs.limit(1)), tmp_path / "twice", "not free")):
        before = names(folder) if folder.exists() else []
        with pytest.raises(Exception, match=why):
            document_sink.write(frame, str(folder))
        assert (names(folder) if folder.exists() else []) == before
    with pytest.raises(Exception, match="no name"):
        document_sink.write(docs.withColumn("name", F.lit("../x")), str(tmp_path / "named"))
    with pytest.raises(Exception, match="only appended"):
        docs.write.format(document_sink.FORMAT).mode("overwrite").save(str(out))


def test_attempts_that_do_not_count_publish_nothing(tmp_path):
    from pyspark.sql import Row

    writer = document_sink.DocumentWriter(str(tmp_path / "d")).prepare()
    first = writer.write(iter([Row(name="a.pdf", content=b"1")]))
    again = writer.write(iter([Row(name="a.pdf", content=b"1")]))  # the same task, run a second time
    assert len(list((tmp_path / "d").glob("*.pdf"))) == 0
    writer.commit([again, None])
    assert names(tmp_path / "d") == ["a.pdf"] and (tmp_path / "d" / "a.pdf").read_bytes() == b"1" and first.files != again.files
