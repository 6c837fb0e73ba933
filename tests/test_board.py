import queue
import threading
import time

import pytest

from strandloom.streaming import board as boards
from strandloom.streaming.progress import STAGES


def drained(q):
    out = []
    while True:
        try:
            out.append(q.get_nowait())
        except queue.Empty:
            return out


def test_slow_subscribers_lose_the_newest():
    b = boards.Board(3)
    slow, other = b.subscribe("a"), b.subscribe("b")
    for k in range(6):
        b.emit("a", "sampling", k / 10)
    assert [e.pct for e in drained(slow)] == [0.02, 0.058, 0.096] and drained(other) == []
    late = b.subscribe("a")
    assert [e.pct for e in drained(late)] == [0.21]  # the last known share
    b.emit("a", "sampling", 0.1)
    b.emit("a", "region", 1.0)
    assert [e.pct for e in drained(late)] == [0.21, 0.45]  # never back
    b.leave("a", late)
    b.cancel("a")
    b.emit("a", "done", 1.0)
    assert drained(late) == [] and drained(slow)[-1].stage == "region"
    with pytest.raises(KeyError):
        b.emit("b", "nothing", 0.5)


def test_a_streaming_query_tells_its_share(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    b = boards.Board()
    mine = b.subscribe("job")
    listener = boards.Streams(b, "sampling", {"job": 40})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream.writeStream.queryName("job").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        events = []
        for _ in range(100):
            events += drained(mine)
            if events and events[-1].stage == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    shares = [e.pct for e in events]
    assert shares == sorted(shares) and shares[-1] == 1.0
    assert {round(STAGES["sampling"][0] + 0.38 * k / 4, 6) for k in (1, 2, 3, 4)} <= set(shares)


def test_a_batch_query_tells_its_tasks(spark):
    b = boards.Board()
    mine = b.subscribe("work")

    def slowly(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    with boards.watched(spark, b, "work", "compose", every=0.1):
        spark.range(0, 800, 1, 16).mapInPandas(slowly, "id long").count()
    events = drained(mine)
    shares = [e.pct for e in events]
    assert shares == sorted(shares) and shares[-1] == 0.95 and any(0.05 < s < 0.95 for s in shares)
    with pytest.raises(ZeroDivisionError), boards.watched(spark, b, "torn", "compose"):
        1 / 0
    assert "torn" not in b.last and threading.active_count() < 50
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
