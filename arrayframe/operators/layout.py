"""Decompositions: who writes which part, joined arrays, local values, codecs as column transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_of(dim: Column, extent: int, parts: int) -> Column:
    """Which of ``parts`` equal parts holds the index; the last takes the remainder."""
    return F.least(F.floor(dim / max(1, extent // parts)), F.lit(parts - 1)).cast("long")


def part_box(extent: int, parts: int, part: int) -> tuple[int, int]:
    size = extent // parts
    return size * part, extent - size * (parts - 1) if part == parts - 1 else size


def rank_of(parts: Sequence[Column], counts: Sequence[int]) -> Column:
    """The writer's rank: the first dimension varies fastest."""
    out, factor = F.lit(0).cast("long"), 1
    for p, n in zip(parts, counts, strict=True):
        out, factor = out + p * factor, factor * n
    return out


def reorganize(cells: DataFrame, dims: Sequence[str], shape: Sequence[int], parts: Sequence[int]) -> DataFrame:
    """The cells under a new decomposition: block_id is the new writer's rank."""
    return cells.withColumn("block_id", rank_of([part_of(F.col(d), n, p) for d, n, p in zip(dims, shape, parts, strict=True)], parts))


def joined_offsets(blocks: DataFrame, order: Sequence[str], count: str, keys: Sequence[str] = ("step",)) -> DataFrame:
    """Where each block of a joined array begins: the running sum of counts before it. ``blocks`` is metadata, a row a block."""
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(count).over(along), F.lit(0)).cast("long"))


def local_values(values: DataFrame, order: str, value: str, keys: Sequence[str] = ("step",)) -> DataFrame:
    """One array for each step of the writers' values, in the order of writers."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return values.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.col(f"p.{value}").alias("values"), F.size("p").cast("long").alias("shape"))


def place_blocks(cells: DataFrame, index: Sequence[str], value: str = "value") -> DataFrame:
    """Overlapping blocks in one global array: at each index the largest block_id wins."""
    return cells.groupBy(*index).agg(F.max_by(value, "block_id").alias(value))


def balance(sizes: Sequence[int], parts: int) -> list[list[int]]:
    """Greedy number partitioning: the largest first, each to the lightest part; indexes into ``sizes``."""
    out, load = [[] for _ in range(parts)], [0] * parts
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = min(range(parts), key=lambda p: (load[p], p))
        out[at].append(i)
        load[at] += sizes[i]
    return out


def quantize(value: Column, error: float, relative_to: Column | None = None) -> Column:
    """The value on a grid that keeps the error within ``error`` (times ``relative_to``)."""
    step = F.lit(2.0 * error) if relative_to is None else 2.0 * error * relative_to
    return F.when(step > 0, F.round(F.try_divide(value, step)) * step).otherwise(value)


def encrypt(frame: DataFrame, value: str, key: bytes) -> DataFrame:
    """The column as AES-GCM bytes."""
    return frame.withColumn(value, F.aes_encrypt(F.col(value).cast("string").cast("binary"), F.lit(key)))


def decrypt(frame: DataFrame, value: str, key: bytes, to: str = "double") -> DataFrame:
    return frame.withColumn(value, F.aes_decrypt(F.col(value), F.lit(key)).cast("string").cast(to))
