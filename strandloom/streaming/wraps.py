"""Page wraps and running offsets over a stream, equal to the batch operators on ordered input.

Rows of one key must arrive in order, within and across micro-batches. The state of a key is one
row: the last observation, or the running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def page_wraps(stream: DataFrame, key: str, order: str, x: str, drop: float) -> DataFrame:
    """(key, order, x) of each boundary: the first observation of a key, and each over ``drop`` left of the one before."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf[pdf[x].notna()].sort_values(order)
            if not len(pdf):
                continue
            last = pdf[x].shift(1)
            last.iloc[0] = before
            yield pdf[last.isna() | (pdf[x] < last - drop)][[key, order, x]]
            before = float(pdf[x].iloc[-1])
        if before is not None:
            state.update((before,))

    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, order, x))
    return stream.select(key, order, x).groupBy(key).applyInPandasWithState(run, schema, "before double", "append", GroupStateTimeout.NoTimeout)


def running_offsets(stream: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """(key, order, offset): running sums of steps that are not negative."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        for pdf in batches:
            pdf = pdf.sort_values(order)
            sums = total + pdf[step].clip(lower=0).cumsum()
            total = float(sums.iloc[-1])
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "offset": sums})
        state.update((total,))

    kinds = dict(stream.dtypes)
    return stream.select(key, order, step).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, offset double", "total double", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Event-time sessions of a key: rows at most ``gap`` apart; rows later than ``late`` are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    windowed = timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
