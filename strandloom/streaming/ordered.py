"""Ordered operators over streams whose rows come out of order within a bound, with a reorder buffer a key.

A row has a number in the sequence of its key. It is handed on once a row that is ``bound`` or more numbers ahead was seen, so any
order in which no row is that late gives the result of the batch operator. When a key has had no row for ``idle`` milliseconds, a
timer hands on what is left and ends the sequence: an operator that holds an open page emits it. The state of a key is one value:
the buffer of at most ``bound`` numbers and what the operator carries. A row whose place has been passed fails the query, or is
left out with ``late="drop"``; a number that comes again while its row is still held replaces it.

State lives in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ``STORE``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandloom.functions import pixels as px
from strandloom.functions.counts import PIXELS, Totals, counted
from strandloom.operators import video
from strandloom.stored import ready

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


class Fold:
    """What is done with the rows of one key, in order. ``carried`` must pickle."""

    def start(self) -> Any:
        return None

    def step(self, carried: Any, row: tuple) -> tuple[Any, list[tuple]]:
        """The new carried value, and rows to emit (without the key)."""
        raise NotImplementedError

    def end(self, carried: Any) -> list[tuple]:
        """Rows to emit when the sequence has ended."""
        return []


class _Buffered(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, order: str, columns: list[str], out: list[str], bound: int, idle: int, late: str):
        self.fold, self.key, self.order, self.columns, self.out, self.bound, self.idle, self.late = fold, key, order, columns, out, bound, idle, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held binary")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict, Any, int, int]:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else ({}, self.fold.start(), -1, -1)

    def _emitted(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.out)

    def _pass(self, buffer: dict, carried: Any, done: int, upto: int) -> tuple[Any, int, list[tuple]]:
        emitted = []
        for n in sorted(n for n in buffer if n <= upto):
            carried, rows = self.fold.step(carried, buffer.pop(n))
            emitted += rows
            done = n
        return carried, done, emitted

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, carried, done, seen = self._load()
        for pdf in rows:
            for row in pdf[self.columns].itertuples(index=False, name=None):
                n = int(row[0])
                if n <= done:
                    if self.late == "fail":
                        raise ValueError(f"row {n} of {key[0]} came more than {self.bound} numbers late")
                    continue
                buffer[n] = row
                seen = max(seen, n)
        carried, done, emitted = self._pass(buffer, carried, done, seen - self.bound)
        self.state.update((pickle.dumps((buffer, carried, done, seen)),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if emitted:
            yield self._emitted(key, emitted)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer, carried, done, seen = self._load()
        carried, done, emitted = self._pass(buffer, carried, done, seen)
        ended = self.fold.end(carried)
        emitted += ended
        self.state.update((pickle.dumps(({}, self.fold.start() if ended else carried, done, seen)),))
        if emitted:
            yield self._emitted(key, emitted)


def folded(stream: DataFrame, fold: Fold, key: str, order: str, columns: list[str], schema: str, bound: int, idle: int = 2000, late: str = "fail") -> DataFrame:
    """Rows that ``fold`` emits over each key's (order, *columns) in order; ``schema`` begins with the key."""
    spark = stream.sparkSession
    if spark.conf.get(_SETTING, "") != STORE:
        raise ValueError(f"ordered streams keep state in RocksDB: set {_SETTING} to {STORE}")
    if late not in ("fail", "drop"):
        raise ValueError("late rows fail or drop")
    ready(spark)
    out = [c.split()[0] for c in schema.split(", ")]
    processor = _Buffered(fold, key, order, [order, *columns], out, bound, idle, late)
    return stream.select(key, order, *columns).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


class _Wraps(Fold):
    def __init__(self, drop: float):
        self.drop = drop

    def step(self, carried, row):
        n, x = row
        if x is None or x != x:
            return carried, []
        return float(x), [(n, x)] if carried is None or x < carried - self.drop else []


class _Sums(Fold):
    def start(self):
        return 0.0

    def step(self, carried, row):
        carried += max(float(row[1]), 0.0)
        return carried, [(row[0], carried)]


def page_wraps(stream: DataFrame, key: str, order: str, x: str, drop: float, bound: int, **more) -> DataFrame:
    """(key, order, x) of each boundary, as :func:`strandloom.operators.seq.page_wraps` finds them in batches; ``order`` counts up."""
    kinds = dict(stream.dtypes)
    return folded(stream, _Wraps(drop), key, order, [x], f"{key} {kinds[key]}, {order} {kinds[order]}, {x} {kinds[x]}", bound, **more)


def running_offsets(stream: DataFrame, key: str, order: str, step: str, bound: int, **more) -> DataFrame:
    """(key, order, offset): running sums of steps that are not negative."""
    kinds = dict(stream.dtypes)
    return folded(stream, _Sums(), key, order, [step], f"{key} {kinds[key]}, {order} {kinds[order]}, offset double", bound, **more)


class _Page:
    """An open page: its brightest pixels, the counts of its inner frames, and its last frame, which may be no inner one."""

    #: Frames that wait to be counted together.
    WAIT = 32

    def __init__(self, start: int, grey: np.ndarray, across: int):
        self.start, self.size, self.across = start, 1, across
        self.top, self.last, self.wait = grey, None, []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * len(range(0, len(grey), PIXELS))

    def add(self, grey: np.ndarray) -> None:
        if self.last is not None:
            self.wait.append(self.last)
            if len(self.wait) >= self.WAIT:
                self._count(lambda totals: None)
        self.last, self.size, self.top = grey, self.size + 1, np.maximum(self.top, grey)

    def _count(self, use: Callable[[Totals], Any]) -> list:
        """Add what waits to the counts, chunk by chunk, and return ``use`` of each chunk's sum."""
        out = []
        for c, at in enumerate(range(0, len(self.top), PIXELS)):
            totals = Totals(len(self.top[at : at + PIXELS]))
            totals.add(*self.counts[c])
            if self.wait:
                totals.add(*counted(np.stack([g[at : at + PIXELS] for g in self.wait])))
            keys = np.flatnonzero(totals.total)
            self.counts[c] = keys.astype(np.int32), totals.total[keys]
            out.append(use(totals))
        self.wait = []
        return out

    def canvas(self) -> tuple[np.ndarray, int, bool]:
        """The composite, how many frames made it, and whether these are too few for a median."""
        inner = self.size - 2
        if inner < video.LEAST:
            return self.top, self.size, True
        return np.concatenate(self._count(lambda totals: totals.median(inner))), inner, False


class _Pages(Fold):
    """Carries (page number or -1 before the first start, last cursor, open page)."""

    def __init__(self, share: float):
        self.share = share

    def start(self):
        return -1, None, None

    def step(self, carried, row):
        number, before, page = carried
        n, x, across, grey = row
        grey = np.frombuffer(grey, np.uint8)
        seen = x is not None and x == x
        begins = seen and (before is None or x < before - self.share * across)
        emitted = [self._told(number, page)] if begins and number >= 0 else []
        if begins:
            number += 1  # frames before the first start belong to no page
        if begins or page is None:
            page = _Page(int(n), grey, int(across))
        else:
            page.add(grey)
        return (number, float(x) if seen else before, page), emitted

    def end(self, carried):
        number, _, page = carried
        return [self._told(max(number, 0), page)] if page is not None else []

    @staticmethod
    def _told(number: int, page: _Page) -> tuple:
        canvas, n, few = page.canvas()
        share = float((canvas > px.PAPER_GREY).mean())
        return number, n, canvas.tobytes(), len(canvas) // page.across, page.across, share < 0.5, few, page.start, page.start + page.size - 1


PAGES = "video_id string, page int, contributors int, canvas binary, height int, width int, transition boolean, low_confidence boolean, start int, end int"


def compose_pages(frames: DataFrame, region: tuple[int, int, int, int], bound: int = 16, **more) -> DataFrame:
    """Pages of a stream of frames, each emitted at the wrap that ends it, the last one when its video falls idle.

    Rows are those of :func:`strandloom.operators.video.compose_pages` over the whole video. A frame is cropped to grey and its
    cursor found where it arrives; the state of a video holds the open page's counts, not its frames.
    """

    def one(row):
        cut = video.array_of(row.height, row.width, row.data)[region[1] : region[3], region[0] : region[2]]
        found = px.cursor_column(cut)
        return [(row.video_id, row.frame_idx, float(found[0]) if found else None, cut.shape[1], px.grey(cut).tobytes())]

    told = video._per_frame(frames, "video_id string, frame_idx int, x double, across int, grey binary", one)
    return folded(told, _Pages(0.3), "video_id", "frame_idx", ["x", "across", "grey"], PAGES, bound, **more)
