"""Array views over the driver's tables: which columns are steps, blocks, indexes and values.

Each view has a DataFrame form, all of it pushable expressions, and the same as
a SQL subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: 1000 cells a step, in 10 blocks."""
    return table(spark, sf_dir, "events").selectExpr("event_id div 1000 AS step", "event_id % 1000 AS d0", "(event_id % 1000) div 100 AS block_id", "((event_id % 1000) div 100) % 4 AS writer", "value", "user_id")


EV = "(SELECT event_id // 1000 AS step, event_id % 1000 AS d0, (event_id % 1000) // 100 AS block_id, ((event_id % 1000) // 100) % 4 AS writer, value, user_id FROM events)"


def ord3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: an array [n, 10, 10] of three fields in blocks of 10 x 10 x 10, one step."""
    return table(spark, sf_dir, "orders").selectExpr("0L AS step", "(o_orderkey div 100) div 10 AS block_id", "o_orderkey div 100 AS d0", "(o_orderkey div 10) % 10 AS d1", "o_orderkey % 10 AS d2", "o_totalprice AS f1", "CAST(o_custkey AS DOUBLE) AS f2", "CAST(o_orderkey % 97 AS DOUBLE) AS f3")


ORD = "(SELECT CAST(0 AS BIGINT) AS step, (o_orderkey // 100) // 10 AS block_id, o_orderkey // 100 AS d0, (o_orderkey // 10) % 10 AS d1, o_orderkey % 10 AS d2, o_totalprice AS f1, CAST(o_custkey AS DOUBLE) AS f2, CAST(o_orderkey % 97 AS DOUBLE) AS f3 FROM orders)"


def emb2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: rows by position."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("step"), F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value")).withColumn("d1", F.col("d1").cast("long"))


EMB = "(SELECT CAST(0 AS BIGINT) AS step, vec_id AS d0, CAST(i AS BIGINT) AS d1, embedding[i + 1] AS value FROM embeddings, unnest(range(len(embedding))) AS t(i))"


def part1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: an int and a double field."""
    return table(spark, sf_dir, "part").selectExpr("0L AS step", "p_partkey AS d0", "p_size", "p_retailprice")


PART = "(SELECT CAST(0 AS BIGINT) AS step, p_partkey AS d0, p_size, p_retailprice FROM part)"


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev1d with every 7th cell moved by 0.5 and every 101st gone."""
    return ev1d(spark, sf_dir).where("(step * 1000 + d0) % 101 <> 0").withColumn("value", F.expr("value + CASE WHEN (step * 1000 + d0) % 7 = 0 THEN 0.5D ELSE 0D END"))


PERTURBED = f"(SELECT step, d0, block_id, value + CASE WHEN (step * 1000 + d0) % 7 = 0 THEN 0.5 ELSE 0 END AS value FROM {EV} WHERE (step * 1000 + d0) % 101 <> 0)"
