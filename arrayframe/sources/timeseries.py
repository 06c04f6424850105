"""Time series: stores listed in a file, their steps one after another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.status import StepStatus


@dataclass(frozen=True)
class Entry:
    path: str
    remote_host: str | None = None
    remote_path: str | None = None
    uuid: str | None = None


class SeriesError(ValueError):
    """A list that can not be read, or stores that do not fit together."""


def parse_list(text: str) -> tuple[list[Entry], bool]:
    """The entries, and whether ``end`` closes the list.

    The YAML subset of such lists: ``- path`` or a map of localpath, remotepath,
    remotehost and uuid; ``#`` begins a comment.
    """
    entries: list[Entry] = []
    closed, current = False, None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip() or line.strip() in ("---", "..."):
            continue
        body = line.strip()
        if body.startswith("-"):
            body, current = body[1:].strip(), None
            if body == "end":
                closed = True
                break
        key, colon, value = body.partition(":")
        fields = {"localpath": "path", "remotepath": "remote_path", "remotehost": "remote_host", "uuid": "uuid"}
        if colon and key.strip().lower() in fields and (value.startswith(" ") or not value):
            if current is None:
                current = {}
                entries.append(current)  # type: ignore[arg-type]
            current[fields[key.strip().lower()]] = value.strip().strip("\"'")
        elif line.strip().startswith("-"):
            entries.append(Entry(body.strip("\"'")))
        else:
            raise SeriesError(f"neither an entry nor a field: {raw!r}")
    return [e if isinstance(e, Entry) else Entry(**({"path": ""} | e)) for e in entries], closed


def lengths(parts: Sequence[DataFrame], step: str = "step") -> list[int]:
    """How many steps each part has: its last and one. Of a store by step it is read from folder names."""
    marked = reduce(DataFrame.union, (p.select(F.lit(i).alias("part"), F.col(step).cast("long").alias("last")) for i, p in enumerate(parts)))
    found = {r.part: r.last + 1 for r in marked.groupBy("part").agg(F.max("last").alias("last")).collect() if r.last is not None}  # a row for each part
    return [found.get(i, 0) for i in range(len(parts))]


def concatenate(parts: Sequence[DataFrame], step: str = "step") -> DataFrame:
    """The parts' steps numbered on: each part's begin after the steps of those before it.

    A part's offset is a constant, so a filter on steps reaches its files;
    columns may be missing in some parts, but a column that two parts have has
    one type.
    """
    if not parts:
        raise SeriesError("an empty series")
    types: dict[str, str] = {}
    for p in parts:
        for name, kind in p.dtypes:
            if types.setdefault(name, kind) != kind:
                raise SeriesError(f"{name} is {types[name]} and {kind}")
    before = accumulate(lengths(parts, step), initial=0)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn(step, F.col(step) + F.lit(n).cast(types[step])) for p, n in zip(parts, before)))


def file_of_step(ranges: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, file): whose first_step to last_step holds the step; ranges are listed by step, so it is an equi-join."""
    listed = ranges.select("file", F.explode(F.sequence("first_step", "last_step")).alias("step"))
    return steps.join(listed, "step").select("step", "file")


def listed(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """The paths of the list's entries, and whether it is closed."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    entries, closed = parse_list(text)
    folder = path.rsplit("/", 1)[0]
    return [e.path if "/" in e.path[:1] or "://" in e.path else f"{folder}/{e.path}" for e in entries if e.path], closed


def read(spark: SparkSession, path: str) -> DataFrame:
    from .engines import read as open_store

    return concatenate([open_store(spark, p) for p in listed(spark, path)[0]])


class Live:
    """A series that may still grow: the list is read again for each step that is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.next = spark, path, 0
        self.cells: DataFrame | None = None

    def begin_step(self) -> StepStatus:
        """OK with ``cells`` the next step's; NOT_READY while the list is open, END_OF_STREAM once ``end`` closes it."""
        from .engines import read as open_store

        paths, closed = listed(self.spark, self.path)
        parts = [open_store(self.spark, p) for p in paths]
        if parts and self.next < sum(lengths(parts)):
            self.cells = concatenate(parts).where(F.col("step") == self.next)
            self.next += 1
            return StepStatus.OK
        return StepStatus.END_OF_STREAM if closed else StepStatus.NOT_READY
