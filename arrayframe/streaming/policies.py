"""What readers of a step stream get under each queue policy, as filters on step numbers.

A live stream's outcome depends on timing; here the timing is explicit: a
schedule of steps that were published while a reader was away or busy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_robin(frame: DataFrame, readers: int, reader: int, step: str = "step") -> DataFrame:
    """The steps of one of several readers that take turns."""
    return frame.where(F.col(step) % readers == reader)


def distribute(frame: DataFrame, mode: str, readers: int, reader: int, schedule: DataFrame | None = None, step: str = "step") -> DataFrame:
    """The steps that ``reader`` gets: all of them, its turns, or those that ``schedule`` (step, reader) says it asked for."""
    if mode == "AllToAll":
        return frame
    if mode == "RoundRobin":
        return round_robin(frame, readers, reader, step)
    if mode == "OnDemand" and schedule is not None:
        return frame.join(schedule.where(F.col("reader") == reader).select(step), step, "left_semi")
    raise ValueError(f"no such distribution: {mode}")


def latest(frame: DataFrame, step: str = "step") -> DataFrame:
    """Only the newest step."""
    return frame.where(F.col(step) == frame.agg(F.max(step)).scalar())


def queued(frame: DataFrame, limit: int, readers: bool = True, first_precious: bool = False, step: str = "step") -> DataFrame:
    """What a queue of ``limit`` steps holds when nothing is taken out.

    With readers the newest are discarded, so the oldest remain; without, the
    oldest are, so the newest remain. A precious first step is kept besides.
    """
    steps = frame.select(step).distinct()
    kept = steps.orderBy(F.asc(step) if readers else F.desc(step)).limit(limit)
    if first_precious:
        kept = kept.union(frame.agg(F.min(step).alias(step))).distinct()
    return frame.join(kept, step, "left_semi")


def reserved(frame: DataFrame, keep: int, step: str = "step") -> DataFrame:
    """The last ``keep`` steps, which late readers still find."""
    return queued(frame, keep, readers=False, step=step)
