"""Stencils over index-keyed cells: neighbours by windows along one dimension at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slope(field: str, dim: str, others: Sequence[str]) -> Column:
    """The difference quotient of ``field`` along ``dim``: central inside, one-sided at the ends."""
    along = Window.partitionBy(*others).orderBy(dim)
    ahead, behind = F.coalesce(F.lead(field).over(along), F.col(field)), F.coalesce(F.lag(field).over(along), F.col(field))
    span = F.coalesce(F.lead(dim).over(along), F.col(dim)) - F.coalesce(F.lag(dim).over(along), F.col(dim))
    return F.when(span != 0, F.try_divide(ahead - behind, span.cast("double"))).otherwise(F.lit(math.nan))


def curl_components(frame: DataFrame, dims: Sequence[str], fields: Sequence[str], within: Sequence[str]) -> DataFrame:
    """``frame``'s keys and dims with ``__v``, the three components of the curl.

    ``within`` names what bounds the stencil: with the block among it, edges of
    blocks are one-sided; without, only those of the array. An axis of one cell
    gives NaN. One shuffle for each dimension, on the other two; none for a frame
    that is dealt by ``within``.
    """
    d0, d1, d2 = dims
    f1, f2, f3 = fields
    out = frame
    for name, field, dim in (("__31", f3, d1), ("__22", f2, d2), ("__12", f1, d2), ("__30", f3, d0), ("__20", f2, d0), ("__11", f1, d1)):
        out = out.withColumn(name, _slope(field, dim, [*within, *(d for d in dims if d != dim)]))
    return out.withColumn("__v", F.array(F.col("__31") - F.col("__22"), F.col("__12") - F.col("__30"), F.col("__20") - F.col("__11"))).select(*within, *dims, "__v")


def widened(frame: DataFrame, dims: Sequence[str], start: Sequence[int], count: Sequence[int], by: int = 1) -> DataFrame:
    """The cells that a stencil over the box reads: filtered before the window, where the scan can use it."""
    cond = F.lit(True)
    for d, s, c in zip(dims, start, count, strict=True):
        cond = cond & (F.col(d) >= s - by) & (F.col(d) < s + c + by)
    return frame.where(cond)


def trimmed(frame: DataFrame, dims: Sequence[str], start: Sequence[int], count: Sequence[int]) -> DataFrame:
    return widened(frame, dims, start, count, 0)


def curl_box(frame: DataFrame, dims: Sequence[str], fields: Sequence[str], within: Sequence[str], start: Sequence[int], count: Sequence[int]) -> DataFrame:
    """The curl in a box: one cell more on each side is read, then cut off."""
    return trimmed(curl_components(widened(frame, dims, start, count), dims, fields, within), dims, start, count)
