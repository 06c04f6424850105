"""Comparison of two stores: values with tolerances, names, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(a: Column, b: Column, absolute: float | None = None, relative: float | None = None) -> Column:
    """Whether two values differ; a tolerance in per cent of \\|a\\| goes before an absolute one; null against a value differs."""
    gap = F.abs(a - b)
    if relative is not None:
        far = F.when(a == 0, gap > 0).otherwise(100 * F.try_divide(gap, F.abs(a)) > relative)
    elif absolute is not None:
        far = gap > absolute
    else:
        far = a != b
    return F.coalesce(far, ~a.eqNullSafe(b))


def diff_values(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", **tolerance: float) -> DataFrame:
    """(keys, left, right) where one side lacks a cell or the two differ."""
    left, right = a.select(*keys, F.col(value).alias("left")), b.select(*keys, F.col(value).alias("right"))
    return left.join(right, list(keys), "full_outer").where(differs(F.col("left"), F.col("right"), **tolerance))


def diff_names(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): names that only the left or only the right has."""
    left, right = a.select(name).distinct(), b.select(name).distinct()
    return left.join(right, name, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, name, "left_anti").withColumn("side", F.lit("right")))


def diff_stats(a: DataFrame, b: DataFrame, keys: Sequence[str], **tolerance: float) -> DataFrame:
    """Groups whose extremes differ; values are not looked at."""
    left = a.select(*keys, F.col("min").alias("left_min"), F.col("max").alias("left_max"))
    right = b.select(*keys, F.col("min").alias("right_min"), F.col("max").alias("right_max"))
    far = differs(F.col("left_min"), F.col("right_min"), **tolerance) | differs(F.col("left_max"), F.col("right_max"), **tolerance)
    return left.join(right, list(keys), "full_outer").where(far)
