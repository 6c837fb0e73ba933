"""Progress of running work, for subscribers that may be slow: bounded queues fed by listeners.

A :class:`Board` holds the queues. :class:`Streams` feeds it from the progress reports of streaming queries; :func:`watched` from
the tasks of the Spark jobs of a group, so that a batch query tells how far it is. What a queue cannot take is dropped, the share
of a job never goes back, and a cancelled job tells nothing more.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from strandloom.streaming.progress import STAGES, WAITING


@dataclass(frozen=True)
class Event:
    job_id: str
    stage: str
    pct: float
    message: str
    ts: float


class Board:
    """Queues of events by job."""

    def __init__(self, most: int = WAITING):
        self.most, self.lock = most, threading.Lock()
        self.queues: dict[str, list[queue.Queue]] = defaultdict(list)
        self.last: dict[str, Event] = {}
        self.cancelled: set[str] = set()

    def subscribe(self, job_id: str) -> queue.Queue:
        """A queue of a job's events from now on, the last one first; many may listen to one job."""
        with self.lock:
            mine: queue.Queue = queue.Queue(self.most)
            if job_id in self.last:
                mine.put_nowait(self.last[job_id])
            self.queues[job_id].append(mine)
            return mine

    def leave(self, job_id: str, mine: queue.Queue) -> None:
        with self.lock:
            self.queues[job_id] = [q for q in self.queues[job_id] if q is not mine]

    def cancel(self, job_id: str) -> None:
        with self.lock:
            self.cancelled.add(job_id)

    def emit(self, job_id: str, stage: str, done: float, message: str = "") -> None:
        """Tell that a share of a stage is done; an unknown stage raises."""
        first, end = STAGES[stage]
        with self.lock:
            if job_id in self.cancelled:
                return
            before = self.last[job_id].pct if job_id in self.last else 0.0
            event = Event(job_id, stage, max(before, round(first + (end - first) * min(max(done, 0.0), 1.0), 6)), message, time.time())
            self.last[job_id] = event
            for q in self.queues[job_id]:
                try:
                    q.put_nowait(event)
                except queue.Full:
                    pass


class Streams(StreamingQueryListener):
    """Tells the rows that a streaming query has read, under its name, as shares of ``expected`` (by name)."""

    def __init__(self, board: Board, stage: str, expected: dict[str, int]):
        self.board, self.stage, self.expected, self.read = board, stage, expected, defaultdict(int)
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        name = event.progress.name
        if name in self.expected:
            self.read[name] += event.progress.numInputRows
            self.board.emit(name, self.stage, self.read[name] / max(self.expected[name], 1), f"batch {event.progress.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.id), None)
        if name in self.expected and event.exception is None:
            self.board.emit(name, "done", 1.0)


@contextmanager
def watched(spark: SparkSession, board: Board, job_id: str, stage: str, every: float = 0.2) -> Iterator[None]:
    """While the block runs, tell the share of finished tasks of the Spark jobs that it has started so far.

    Jobs are known by a group of their own; jobs that are planned later lower the share, which is then held.
    """
    context, ended = spark.sparkContext, threading.Event()
    context.setJobGroup(job_id, stage)

    def poll() -> None:
        tracker = context.statusTracker()
        while not ended.wait(every):
            infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(job_id) for s in (tracker.getJobInfo(j) or _NONE).stageIds]
            infos = [i for i in infos if i is not None]
            total = sum(i.numTasks for i in infos)
            if total:
                done = sum(i.numCompletedTasks for i in infos)
                board.emit(job_id, stage, done / total, f"{done} of {total} tasks")

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
        ended.set()
        thread.join()
        board.emit(job_id, stage, 1.0)
    finally:
        ended.set()
        context.setLocalProperty("spark.jobGroup.id", None)


class _NONE:
    stageIds: tuple = ()
