"""Scripted workloads: arrays by formula, written and read back, with timings.

A script has a command a line, ``#`` begins a comment:

    steps 3
    array u double 100,50 4      name, type, shape, blocks of the first dimension
    write run u,v                store, arrays (one shape)
    read run u 10,0 20,50        store, array, and a box if wanted
    sleep 0.5
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import part_of
from ..operators.selection import Selection
from ..sources import engines
from ..types import TYPES


class WorkloadError(ValueError):
    """A script line that says nothing known."""


@dataclass(frozen=True)
class Array:
    type: str
    shape: tuple[int, ...]
    blocks: int


@dataclass
class Workload:
    steps: int = 1
    arrays: dict[str, Array] = field(default_factory=dict)
    commands: list[tuple[str, list[str]]] = field(default_factory=list)


def parse(text: str) -> Workload:
    out = Workload()
    for raw in text.splitlines():
        words = raw.split("#")[0].split()
        if not words:
            continue
        name, args = words[0], words[1:]
        if name == "steps" and len(args) == 1:
            out.steps = int(args[0])
        elif name == "array" and len(args) in (3, 4) and args[1] in TYPES:
            out.arrays[args[0]] = Array(args[1], tuple(map(int, args[2].split(","))), int(args[3]) if len(args) == 4 else 1)
        elif (name, len(args)) in (("write", 2), ("read", 2), ("read", 4), ("sleep", 1)):
            if name != "sleep" and (missing := [a for a in args[1].split(",") if a not in out.arrays]):
                raise WorkloadError(f"no such array: {missing}")
            out.commands.append((name, args))
        else:
            raise WorkloadError(f"not a command: {raw!r}")
    return out


def cells(spark: SparkSession, arrays: dict[str, Array], steps: int) -> DataFrame:
    """Wide cells of arrays of one shape: each value is 1000 step + the row-major index + the array's number."""
    shapes = {(a.shape, a.blocks) for a in arrays.values()}
    if len(shapes) != 1:
        raise WorkloadError("arrays that are written together share shape and blocks")
    ((shape, blocks),) = shapes
    total = 1
    for n in shape:
        total *= n
    out = spark.range(steps * total).select(F.floor(F.col("id") / total).alias("step"), (F.col("id") % total).alias("at"))
    rest = total
    for i, n in enumerate(shape):
        rest //= n
        out = out.withColumn(f"d{i}", F.floor(F.col("at") / rest) % n)
    out = out.withColumn("block_id", part_of(F.col("d0"), shape[0], blocks))
    values = [(1000 * F.col("step") + F.col("at") + k).cast(TYPES[a.type].spark).alias(name) for k, (name, a) in enumerate(arrays.items())]
    return out.select("step", "block_id", *(f"d{i}" for i in range(len(shape))), *values)


def run(spark: SparkSession, text: str, folder: str) -> list[tuple[str, str, int, float]]:
    """(command, target, cells, seconds) of each command, in order."""
    work, out = parse(text), []
    for name, args in work.commands:
        began, count = time.perf_counter(), 0
        if name == "sleep":
            time.sleep(float(args[0]))
        else:
            path, names = f"{folder}/{args[0]}", args[1].split(",")
            dims = [f"d{i}" for i in range(len(work.arrays[names[0]].shape))]
            if name == "write":
                frame = cells(spark, {n: work.arrays[n] for n in names}, work.steps)
                engines.write(frame, path, order=tuple(dims))
            frame = engines.read(spark, path)
            if len(args) == 4:
                frame = Selection.bounding_box(*(list(map(int, a.split(","))) for a in args[2:])).apply(frame, dims)
            count = frame.select("step", *names).agg(F.count("*")).first()[0]
        out.append((name, args[0], count, time.perf_counter() - began))
    return out
