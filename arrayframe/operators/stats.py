"""Statistics: per block, per sub-block, per step and over all; each level merges the level below."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SUB_BLOCKS = 4096


def block_stats(cells: DataFrame, dims: Sequence[str], value: str = "value", keys: Sequence[str] = ("step", "block_id")) -> DataFrame:
    """The blocks table: for each block start and count of every dimension, and the extremes. Aggregated before it moves."""
    boxes = [x for d in dims for x in (F.min(d).alias(f"start_{d}"), (F.max(d) - F.min(d) + 1).alias(f"count_{d}"))]
    return cells.groupBy(*keys).agg(*boxes, F.min(value).alias("min"), F.max(value).alias("max"))


def merge_stats(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extremes of ``stats`` (min, max) merged to ``keys``."""
    return stats.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"))


def complex_extremes(cells: DataFrame, re: str, im: str, keys: Sequence[str]) -> DataFrame:
    """The smallest and largest complex value of each group by squared magnitude; ties go to the smaller (re, im)."""
    norm = F.col(re) * F.col(re) + F.col(im) * F.col(im)
    low = F.min(F.struct(norm.alias("n"), F.col(re).alias("re"), F.col(im).alias("im"))).alias("low")
    high = F.max(F.struct(norm.alias("n"), (-F.col(re)).alias("re"), (-F.col(im)).alias("im"))).alias("high")
    return cells.groupBy(*keys).agg(low, high).select(*keys, F.col("low.re").alias("min_re"), F.col("low.im").alias("min_im"), (-F.col("high.re")).alias("max_re"), (-F.col("high.im")).alias("max_im"))


def divide_block(count: Sequence[int], sub_block_size: int) -> list[int]:
    """Into how many parts each dimension is cut, the slowest first, for sub-blocks of about that many elements."""
    total = 1
    for c in count:
        total *= c
    left = max(1, min(MOST_SUB_BLOCKS, -(-total // sub_block_size)))
    parts = []
    for c in count:
        part = left if left < c else c
        parts.append(max(1, part) if left > 1 else 1)
        left = 1 if left < c else left // c
    return parts


def sub_boxes(count: Sequence[int], parts: Sequence[int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(start, count) of all sub-blocks in row-major order; the first ones take the remainder."""
    out: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((), ())]
    for c, p in zip(count, parts, strict=True):
        base, more = divmod(c, p)
        spans = [(i * base + min(i, more), base + (i < more)) for i in range(p)]
        out = [((*s, a), (*n, b)) for s, n in out for a, b in spans]
    return out


def sub_block_id(offset: Column, count: int, parts: int) -> Column:
    """Which part of a dimension holds the local ``offset``."""
    base, more = divmod(count, parts)
    edge = more * (base + 1)
    if not more:
        return F.floor(offset / base)
    return F.when(offset < edge, F.floor(offset / (base + 1))).otherwise(more + F.floor((offset - edge) / base))


def sub_block_stats(cells: DataFrame, dims: Sequence[str], counts: Sequence[int], size: int, origin: Sequence[Column], value: str = "value") -> DataFrame:
    """Extremes of each block's sub-blocks: step, block_id, sub_id, min, max."""
    parts = divide_block(counts, size)
    sub = F.lit(0)
    for d, c, p, o in zip(dims, counts, parts, origin, strict=True):
        sub = sub * p + sub_block_id(F.col(d) - o, c, p)
    return cells.withColumn("sub_id", sub.cast("long")).groupBy("step", "block_id", "sub_id").agg(F.min(value).alias("min"), F.max(value).alias("max"))


def histogram(cells: DataFrame, slice_: str, value: str, bins: int) -> DataFrame:
    """Equal-width counts of each slice between the overall extremes; the largest value is in the last bin.

    The extremes are scalar subqueries; a constant variable falls into bin 0.
    """
    lo, hi = cells.agg(F.min(value)).scalar(), cells.agg(F.max(value)).scalar()
    place = F.when(hi <= lo, 0).otherwise(F.least(F.floor(F.try_divide(F.col(value) - lo, (hi - lo) / bins)), F.lit(bins - 1)))
    return cells.withColumn("bin", place.cast("long")).groupBy(slice_, "bin").agg(F.count("*").alias("n"))


def moments(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, average and standard deviation (of the population) of each group."""
    return cells.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.stddev_pop(value).alias("std_dev"))
