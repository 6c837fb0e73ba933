import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import seq, video
from strandloom.sources import frames as src
from strandloom.streaming import ordered
from tests.shapes import frame, rows, staff


@pytest.fixture
def rocks(spark):
    spark.conf.set(ordered._SETTING, ordered.STORE)
    yield spark
    spark.conf.unset(ordered._SETTING)


def shuffled(items, bound, r):
    """An order in which nothing comes ``bound`` or more numbers late."""
    return sorted(items, key=lambda x: x[1] + r.random() * (bound - 1))


def run(spark, tmp_path, parts, schema, build, want, kind="json"):
    """The rows of a stream over ``parts``, one file a micro-batch, once there are ``want`` of them."""
    folder = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").format(kind).save(str(folder / f"{i:03d}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).format(kind).load(str(folder))
    name = f"t{random.randrange(10**9)}"
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(240):
            if q.exception():
                raise q.exception()
            if spark.table(name).count() >= want:
                break
            time.sleep(0.5)
        time.sleep(1)
        return spark.table(name).collect()
    finally:
        q.stop()


def test_rows_out_of_order_give_the_batch_result(rocks, tmp_path):
    spark, r, bound = rocks, random.Random(5), 12
    rows_ = [(f"v{i % 3}", i // 3, None if r.random() < 0.1 else float((i * 37) % 100)) for i in range(150)]
    mixed = shuffled(rows_, bound, r)
    assert mixed != rows_
    schema = "video string, frame long, x double"
    parts = [mixed[k : k + 40] for k in range(0, 150, 40)]
    batch = spark.createDataFrame(rows_, schema)
    want = sorted((x.video, x.frame, x.x) for x in seq.page_wraps(batch, ["video"], ["frame"], "x", F.lit(30.0)).select("video", "frame", "x").collect())
    got = run(spark, tmp_path / "w", parts, schema, lambda s: ordered.page_wraps(s, "video", "frame", "x", 30.0, bound, idle=3000), len(want))
    assert sorted(map(tuple, got)) == want and len(want) > 10
    full = [(v, n, x or 0.0) for v, n, x in mixed]
    sums = {}
    for v, n, x in sorted(full):
        sums[v, n] = sums.get((v, n - 1), 0.0) + x
    got = run(spark, tmp_path / "o", [full[k : k + 40] for k in range(0, 150, 40)], schema, lambda s: ordered.running_offsets(s, "video", "frame", "x", bound, idle=3000), 150)
    assert {(x.video, x.frame): x.offset for x in got} == sums and len(got) == 150


def test_a_row_beyond_the_bound(rocks, tmp_path):
    schema = "video string, frame long, x double"
    parts = [[("v", n, 1.0) for n in range(1, 12)], [("v", 0, 1.0)]]
    with pytest.raises(Exception, match="numbers late"):
        run(rocks, tmp_path / "f", parts, schema, lambda s: ordered.running_offsets(s, "video", "frame", "x", 4, idle=60_000), 99)
    got = run(rocks, tmp_path / "d", parts, schema, lambda s: ordered.running_offsets(s, "video", "frame", "x", 4, idle=3000, late="drop"), 11)
    assert [x.offset for x in sorted(got, key=lambda x: x.frame)] == [float(k) for k in range(1, 12)]


def test_needs_its_state_store(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("v").alias("video"), F.col("value").alias("frame"), F.lit(1.0).alias("x"))
    with pytest.raises(ValueError, match="RocksDB"):
        ordered.page_wraps(stream, "video", "frame", "x", 1.0, 4)


def test_open_pages_count_like_numpy(monkeypatch):
    monkeypatch.setattr(ordered._Page, "WAIT", 5)
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 6, 40):
        stack = r.integers(0, 256, (n, 5000)).astype(np.uint8)
        page = ordered._Page(7, stack[0], 50)
        for g in stack[1:]:
            page.add(g)
        canvas, contributors, few = page.canvas()
        want = stack.max(axis=0) if n < 5 else np.median(stack[1:-1], axis=0).astype(np.uint8)
        assert (canvas == want).all() and few == (n < 5) and contributors == (n if n < 5 else n - 2)


def test_pages_are_emitted_at_their_wraps(rocks, tmp_path):
    spark, box, size = rocks, (24, 16, 224, 100), (120, 250)
    w, h = box[2] - box[0], box[3] - box[1]
    paged = [frame(staff(w, h, c, gap=14), cursor=8 + s * 30, region=box, size=size) for c, n in ((0, 6), (1, 4), (2, 6)) for s in range(n)]
    ahead = [frame(staff(w, h, 9, gap=14), region=box, size=size)] * 2  # no cursor yet: part of no page
    still = [frame(staff(w, h, 5, gap=14), region=box, size=size)] * 7  # no cursor at all: one page
    data = rows(ahead + paged, "a") + rows(still, "b")
    frames = spark.createDataFrame(data, src.SCHEMA)
    batch = video.compose_pages(video.page_frames(frames, video.page_starts(video.cursor_track(frames, box))), box)
    columns = ["video_id", "page", "contributors", "height", "width", "transition", "low_confidence", "start", "end", "canvas"]
    want = sorted(tuple(x) for x in batch.select(columns).collect())
    mixed = shuffled(data, 4, random.Random(2))
    parts = [mixed[k : k + 9] for k in range(0, len(mixed), 9)]
    got = run(spark, tmp_path, parts, src.SCHEMA, lambda s: ordered.compose_pages(s, box, 4, idle=8000).select(columns), len(want), "parquet")
    assert sorted(map(tuple, got)) == want and [x[:2] for x in want] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert want[1][6] and not want[0][6]
