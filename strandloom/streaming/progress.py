"""Progress of jobs as a stream of events (job_id, stage, pct, message, ts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Share of the whole at which each stage begins and ends; sampling and composing grow with what is done.
STAGES = {"sampling": (0.02, 0.40), "region": (0.45, 0.45), "advance": (0.7, 0.7), "songs": (0.85, 0.85), "compose": (0.05, 0.95), "merge": (0.97, 0.97), "done": (1.0, 1.0)}
#: Messages that wait for a subscriber before newer ones are dropped.
WAITING = 256


def overall(stage: Column, done: Column) -> Column:
    """Share of the whole from the share of a stage, forced into the stage's band; null for an unknown stage."""
    out = None
    for name, (a, b) in STAGES.items():
        at = F.lit(a) + (b - a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), done))
        out = F.when(stage == name, at) if out is None else out.when(stage == name, at)
    return F.round(out, 6)


def never_back(events: DataFrame) -> DataFrame:
    """Events of a job whose share is at least that of all before them."""
    w = Window.partitionBy("job_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("pct", F.max("pct").over(w))


def bounded(batch: DataFrame, most: int = WAITING) -> DataFrame:
    """The first ``most`` messages of each job in a micro-batch: newer ones are dropped where a subscriber is slow."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("ts"))
    return batch.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def publish(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, most: int = WAITING, cancelled: Callable[[], bool] | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``deliver``, at most ``most`` messages a job; once ``cancelled`` tells so, nothing more is delivered.

    ``every`` is the trigger interval (a poll beside the push); without one the stream runs until its input is read.
    """

    def each(batch: DataFrame, number: int) -> None:
        if cancelled is None or not cancelled():
            deliver(bounded(batch, most), number)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
