"""Profiles: timings that ranks report as JSON, aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timings(reports: DataFrame, column: str, rank: str = "rank") -> DataFrame:
    """(rank, name, value) of each numeric field of a JSON object column."""
    fields = F.from_json(F.col(column), "map<string, double>")
    return reports.select(rank, F.explode(fields).alias("name", "value"))


def summary(timing: DataFrame) -> DataFrame:
    """Over ranks: how often each timer ran, its total, least and most."""
    return timing.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
