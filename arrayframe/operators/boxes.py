"""Box algebra on (start, count) columns and tuples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[tuple[int, ...], tuple[int, ...]]


def overlap(start_a: Column, count_a: Column, start_b: Column, count_b: Column) -> Column:
    """Whether two half-open intervals meet."""
    return (start_a < start_b + count_b) & (start_b < start_a + count_a)


def clip(start: Column, count: Column, lower: Column, size: Column) -> tuple[Column, Column]:
    """Start and count of the interval within another."""
    first = F.greatest(start, lower)
    return first, F.least(start + count, lower + size) - first


def intersect(a: Box, b: Box) -> Box | None:
    start = tuple(max(x, y) for x, y in zip(a[0], b[0], strict=True))
    end = tuple(min(x + c, y + d) for x, c, y, d in zip(a[0], a[1], b[0], b[1], strict=True))
    count = tuple(e - s for s, e in zip(start, end, strict=True))
    return (start, count) if all(c > 0 for c in count) else None


def subtract(a: Box, b: Box) -> Iterator[Box]:
    """``a`` without ``b`` as disjoint boxes, cut dimension by dimension."""
    common = intersect(a, b)
    if common is None:
        yield a
        return
    start, count = list(a[0]), list(a[1])
    for i, (s, c) in enumerate(zip(*common, strict=True)):
        for lo, hi in ((start[i], s), (s + c, start[i] + count[i])):
            if hi > lo:
                yield tuple([*start[:i], lo, *start[i + 1 :]]), tuple([*count[:i], hi - lo, *count[i + 1 :]])
        start[i], count[i] = s, c


def linear_index(dims: Sequence[Column], shape: Sequence[int], row_major: bool = True) -> Column:
    """The element's place in a contiguous buffer."""
    pairs = list(zip(dims, shape, strict=True))
    out = F.lit(0).cast("long")
    for d, n in pairs if row_major else reversed(pairs):
        out = out * n + d
    return out


def is_contiguous(box: Box, shape: Sequence[int]) -> bool:
    """Whether the box is one run of a row-major buffer of ``shape``."""
    wide = False
    for i in range(len(shape) - 1, -1, -1):
        if wide and box[1][i] != 1:
            return False
        wide = wide or box[1][i] != shape[i]
    return True


def match_blocks(blocks: DataFrame, boxes: DataFrame, dims: int, cell: int) -> DataFrame:
    """Every (reader box, writer block) that meet: readers' r_start and r_count arrays against start and count.

    A range join by a grid of ``cell`` wide strips of the first dimension: both
    sides are listed under the strips that they touch and joined on the strip,
    so no side is broadcast and no pair of far ones is formed.
    """
    def stripped(df: DataFrame, start: str, count: str) -> DataFrame:
        first, last = F.floor(F.get(start, 0) / cell), F.floor((F.get(start, 0) + F.get(count, 0) - 1) / cell)
        return df.where(F.get(count, 0) > 0).withColumn("strip", F.explode(F.sequence(first, last)))

    a, b = stripped(blocks, "start", "count"), stripped(boxes, "r_start", "r_count")
    meets = reduce(and_, (overlap(F.get("start", i), F.get("count", i), F.get("r_start", i), F.get("r_count", i)) for i in range(dims)))
    # a pair is kept in the strip where its overlap begins
    home = F.col("strip") == F.floor(F.greatest(F.get("start", 0), F.get("r_start", 0)) / cell)
    parts = [clip(F.get("start", i), F.get("count", i), F.get("r_start", i), F.get("r_count", i)) for i in range(dims)]
    joined = a.join(b, "strip").where(meets & home).drop("strip")
    return joined.withColumn("o_start", F.array(*(p[0] for p in parts))).withColumn("o_count", F.array(*(p[1] for p in parts)))
