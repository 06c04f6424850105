"""Queries on derived variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derived import column, derive
from ..functions.stencil import curl_box
from .registry import query
from .views import EMB, ORD, PART, emb2d, ord3d, part1d

D3 = ["d0", "d1", "d2"]


def _part(name: str, expression: str, sql: str, digits: int | None = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = part1d(spark, sf_dir)
        value = column(expression, frame)
        return frame.select("d0", (F.round(value, digits) if digits is not None else value).alias("value"))

    run.__name__ = name
    query(f"SELECT d0, {f'round({sql}, {digits}) + 0.0' if digits is not None else sql} AS value FROM {PART}")(run)


_part("d_add", "p_retailprice + p_size", "p_retailprice + p_size")
_part("d_sub", "subtract(p_retailprice, p_size, 1.5)", "p_retailprice - p_size - 1.5")
_part("d_mul", "p_retailprice * p_size * 2", "p_retailprice * p_size * 2")
_part("d_div", "p_retailprice / p_size", "p_retailprice / CAST(p_size AS DOUBLE)")
_part("d_div_int", "p_size / 7", "CAST(p_size // 7 AS INTEGER)", None)
_part("d_neg", "-p_size", "-p_size", None)
_part("d_pow", "p_retailprice ^ 1.5", "pow(p_retailprice, 1.5)", 4)
_part("d_pow1", "pow(p_size)", "p_size * p_size", None)
_part("d_sqrt", "sqrt(p_retailprice)", "sqrt(p_retailprice)")
_part("d_trig", "sin(p_size) + cos(p_size) * tan(p_retailprice / 1000)", "sin(p_size) + cos(p_size) * tan(p_retailprice / 1000)")
_part("d_atrig", "asin(p_size / 100.0) + acos(1 / (p_retailprice + 2)) + atan(p_retailprice)", "asin(p_size // 100) + acos(1 / (p_retailprice + 2)) + atan(p_retailprice)")
_part("d_mag", "magnitude(p_retailprice, p_size)", "sqrt(p_retailprice * p_retailprice + CAST(p_size AS DOUBLE) * p_size)")
_part("d_mixed_types", "p_size + p_retailprice * p_size", "p_size + p_retailprice * p_size")
_part("d_composed", "x = p_retailprice\nsqrt(sum(pow(x), x, 2))", "sqrt(p_retailprice * p_retailprice + p_retailprice + 2)")
_part("d_nary", "add(p_size, p_size, p_retailprice, 3)", "p_size + p_size + p_retailprice + 3")
_part("d_precedence", "-p_retailprice ^ 2 + 2 * p_size ** 2", "-(p_retailprice * p_retailprice) + 2 * p_size * p_size")


@query(f"SELECT step, d0, round(sum(CAST(value AS DOUBLE)), 6) + 0.0 AS value FROM {EMB} GROUP BY step, d0")
def d_sum_lastdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(emb2d(spark, sf_dir), "sum(value)", ["d0", "d1"]).withColumn("value", F.round("value", 6))


@query(f"SELECT step, d0, round(sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))), 6) AS value FROM {EMB} GROUP BY step, d0")
def d_mag_lastdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(emb2d(spark, sf_dir), "magnitude(value)", ["d0", "d1"]).withColumn("value", F.round("value", 6))


_CROSS = f"(SELECT d0, d1, d2, [f2 * f2 - f3 * f1, f1 * f2 - f3 * f3, f1 * f1 - f2 * f3] AS v FROM {ORD})"


@query(f"SELECT d0, d1, d2, CAST(i AS BIGINT) AS comp, round(v[i + 1] / 1e6, 4) + 0.0 AS value FROM {_CROSS}, range(0, 3) AS t(i)")
def d_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a = (f1, f2, f3), b = (f3, f1, f2), the middle component with the sign of the expression language
    return derive(ord3d(spark, sf_dir), "cross(f1, f2, f3, f3, f1, f2)", D3).select(*D3, "comp", F.round(F.col("value") / 1e6, 4).alias("value"))


def _slope_sql(f: str, d: str, within: str) -> str:
    w = f"OVER (PARTITION BY {within}, {', '.join(x for x in D3 if x != d)} ORDER BY {d})"
    ahead, behind = (f"coalesce({g}({f}) {w}, {f})" for g in ("lead", "lag"))
    high, low = (f"coalesce({g}({d}) {w}, {d})" for g in ("lead", "lag"))
    return f"CASE WHEN {high} - {low} <> 0 THEN ({ahead} - {behind}) / ({high} - {low}) ELSE 'NaN'::DOUBLE END"


def _curl_sql(source: str, within: str) -> str:
    s = lambda f, d: _slope_sql(f, d, within)
    return f"(SELECT step, block_id, d0, d1, d2, [{s('f3', 'd1')} - {s('f2', 'd2')}, {s('f1', 'd2')} - {s('f3', 'd0')}, {s('f2', 'd0')} - {s('f1', 'd1')}] AS v FROM {source})"


_CURL = _curl_sql(ORD, "step, block_id")


@query(f"SELECT d0, d1, d2, CAST(i AS BIGINT) AS comp, round(v[i + 1], 4) + 0.0 AS value FROM {_CURL}, range(0, 3) AS t(i)")
def d_curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(ord3d(spark, sf_dir), "curl(f1, f2, f3)", D3, keys=("step", "block_id")).select(*D3, "comp", F.round("value", 4).alias("value"))


_IN = "d0 >= {0} AND d0 < {1} AND d1 >= {0} AND d1 < {1} AND d2 >= {0} AND d2 < {1}"


@query(f"SELECT d0, d1, d2, round(v[1], 4) + 0.0 AS c0, round(v[2], 4) + 0.0 AS c1, round(v[3], 4) + 0.0 AS c2 FROM {_curl_sql(f'(SELECT * FROM {ORD} WHERE {_IN.format(2, 7)})', 'step')} WHERE {_IN.format(3, 6)}")
def d_curl_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curl_box(ord3d(spark, sf_dir), D3, ["f1", "f2", "f3"], ["step"], [3, 3, 3], [3, 3, 3])
    return out.select(*D3, *(F.round(F.get("__v", i), 4).alias(f"c{i}") for i in range(3)))


@query(f"SELECT d0, d1, d2, round(sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]), 4) AS value FROM {_CURL}")
def d_mag_curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    curl = derive(ord3d(spark, sf_dir), "curl(f1, f2, f3)", D3, keys=("step", "block_id"))
    return derive(curl, "magnitude(value)", [*D3, "comp"]).select(*D3, F.round("value", 4).alias("value"))


@query(f"SELECT min(value) AS min, max(value) AS max FROM (SELECT round(p_retailprice * 2, 6) AS value FROM {PART})")
def d_stats_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.derived import store

    return store(part1d(spark, sf_dir), "p_retailprice * 2", ["d0"], kind="stats").select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query(f"SELECT d0, d1, d2, CAST(i AS BIGINT) AS comp, round(v[i + 1], 4) + 0.0 AS value FROM {_CURL}, range(0, 3) AS t(i)")
def d_curl_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curl of one array whose component planes are numbered."""
    planes = ord3d(spark, sf_dir).select("step", "block_id", *D3, F.posexplode(F.array("f1", "f2", "f3")).alias("comp", "v"))
    return derive(planes, "curl(v)", D3, keys=("step", "block_id")).select(*D3, "comp", F.round("value", 4).alias("value"))
