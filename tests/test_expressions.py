"""The expression language: reading, typing, values."""

import math

import pytest
from pyspark.sql import functions as F

from arrayframe.functions.derived import column, derive
from arrayframe.functions.parser import Call, ExpressionError, Name, Number, parse, variables
from arrayframe.functions.stencil import curl_box
from arrayframe.types import PromotionError, promote


def test_precedence():
    assert parse("-x^2") == Call("negate", (Call("pow", (Name("x"), Number(2.0, "2"))),))
    assert parse("2^x^2") == Call("pow", (Number(2.0, "2"), Call("pow", (Name("x"), Number(2.0, "2")))))
    assert parse("a - b - c") == Call("subtract", (Call("subtract", (Name("a"), Name("b"))), Name("c")))
    assert parse("a + b * c") == Call("add", (Name("a"), Call("multiply", (Name("b"), Name("c")))))


def test_names():
    assert parse("a/b + 1").args[0] == Name("a/b") and parse("a / b").function == "divide"
    assert variables(parse("x = sim/V.x\ny = `odd name`\nx + y * x")) == ["sim/V.x", "odd name"]
    assert parse("MAGNITUDE(x)").function == "magnitude"


@pytest.mark.parametrize("text", ["", "1 + 2", "x +", "f(x)", "x[1]", "subtract(x)", "cross(x, y)", "curl(x, y)", "x $ y", "sqrt(x, y)", "(x"])
def test_refused(text):
    with pytest.raises(ExpressionError):
        parse(text)


@pytest.mark.parametrize(("a", "b", "out"), [("float", "double", "double"), ("int16", "double", "double"), ("int32", "float", "float"), ("int16", "int32", "int32"), ("uint8", "uint16", "uint16"), ("int64", "float", "double"), ("int8", "uint8", "double")])
def test_promotion(a, b, out):
    assert promote(a, b) == promote(b, a) == out


def test_strict_promotion():
    for pair in (("int64", "float"), ("int32", "uint32"), ("string", "double")):
        with pytest.raises(PromotionError):
            promote(*pair, strict=True)


def wide(spark):
    return spark.range(10).selectExpr("0L AS step", "0L AS block_id", "id AS d0", "CAST(id * 1.5 AS FLOAT) AS F", "id * 2.5D AS D", "CAST(3 * id AS SMALLINT) AS I", "CAST(id AS DOUBLE) AS x", "CAST(id AS INT) AS n")


@pytest.mark.parametrize(("text", "kind", "of"), [
    ("F + D", "double", lambda i: 4.0 * i), ("I + D", "double", lambda i: 5.5 * i), ("I + F", "float", lambda i: 4.5 * i), ("n / 2", "int", lambda i: i // 2), ("n + 2.7", "int", lambda i: i + 2), ("n ^ 2", "int", lambda i: i * i),
    ("sqrt(sum(pow(x), x, 2))", "double", lambda i: math.sqrt(i * i + i + 2)), ("x / n", "double", lambda i: 1.0 if i else math.nan), ("1 / x", "double", lambda i: 1 / i if i else math.inf), ("-1 / x", "double", lambda i: -1 / i if i else -math.inf),
    ("sqrt(0 - x)", "double", lambda i: math.nan if i else 0.0), ("magnitude(n, x)", "double", lambda i: math.hypot(i, i)), ("2 ^ x", "double", lambda i: 2.0**i),
])
def test_values(spark, text, kind, of):
    frame = wide(spark)
    got = frame.select("d0", column(text, frame).alias("v"))
    assert got.schema["v"].dataType.simpleString() == kind
    for r in got.collect():
        assert r.v == pytest.approx(of(r.d0), nan_ok=True, rel=1e-6)


def test_integer_division_by_zero_is_null(spark):
    frame = wide(spark)
    assert [r.v for r in frame.select(column("n / (n - n)", frame).alias("v")).collect()] == [None] * 10


def test_unknown_variable_and_unsigned(spark):
    frame = wide(spark)
    with pytest.raises(KeyError):
        column("nothing + 1", frame)
    unsigned = frame.withColumn("u", F.col("n").cast("decimal(20,0)"))
    with pytest.raises(ExpressionError):
        column("-u", unsigned)


def grid(spark, a=6, b=7, c=5):
    cells = spark.range(a * b * c).selectExpr("0L AS step", "0L AS block_id", f"id div {b * c} AS d0", f"(id div {c}) % {b} AS d1", f"id % {c} AS d2")
    x, y, z = (F.col(d).cast("double") for d in ("d0", "d1", "d2"))
    return cells.withColumns({"f1": 6 * x * y + 7 * z, "f2": 4 * x * z + y * y, "f3": F.sqrt(z) + 2 * x * y})


def test_curl_is_analytic(spark):
    got = derive(grid(spark), "curl(f1, f2, f3)", ["d0", "d1", "d2"])
    for r in got.collect():
        assert r.value == pytest.approx((-2 * r.d0, 7 - 2 * r.d1, 4 * r.d2 - 6 * r.d0)[r.comp], abs=1e-9)


def test_curl_box_equals_the_whole(spark):
    dims, frame = ["d0", "d1", "d2"], grid(spark)
    whole = {(r.d0, r.d1, r.d2, r.comp): r.value for r in derive(frame, "curl(f1, f2, f3)", dims).collect()}
    for r in curl_box(frame, dims, ["f1", "f2", "f3"], ["step"], [1, 2, 1], [3, 2, 2]).collect():
        assert r["__v"] == pytest.approx([whole[r.d0, r.d1, r.d2, k] for k in range(3)])


def test_curl_of_one_array(spark):
    dims, frame = ["d0", "d1", "d2"], grid(spark)
    planes = frame.select("step", "block_id", *dims, F.posexplode(F.array("f1", "f2", "f3")).alias("comp", "v"))
    of = lambda x: sorted((r.d0, r.d1, r.d2, r.comp, r.value) for r in x.collect())
    assert of(derive(planes, "curl(v)", dims)) == of(derive(frame, "curl(f1, f2, f3)", dims))
    with pytest.raises(ExpressionError):
        derive(frame, "curl(f1)", dims)


def test_curl_on_a_flat_axis_is_nan(spark):
    got = derive(grid(spark, 1, 3, 3), "curl(f1, f2, f3)", ["d0", "d1", "d2"])
    assert all(math.isnan(r.value) == (r.comp != 0) for r in got.collect())


def test_reductions(spark):
    frame = spark.range(12).selectExpr("0L AS step", "id div 4 AS d0", "id % 4 AS d1", "CAST(id AS DOUBLE) AS v")
    got = {r.d0: r.value for r in derive(frame, "sqrt(sum(v)) + magnitude(v * 2)", ["d0", "d1"]).collect()}
    for k in range(3):
        vs = [4 * k + j for j in range(4)]
        assert got[k] == pytest.approx(math.sqrt(sum(vs)) + math.sqrt(sum(4 * v * v for v in vs)))
    with pytest.raises(ExpressionError):
        derive(frame, "sum(v) + v", ["d0", "d1"])


def test_cross_sign(spark):
    frame = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0)], "step bigint, d0 bigint, a double, b double, c double, p double, q double, r double")
    names = "(a, b, c, p, q, r)"
    assert [r.value for r in derive(frame, "cross" + names, ["d0"]).orderBy("comp").collect()] == [-1.0, -5.0, -3.0]
    assert [r.value for r in derive(frame, "cross_std" + names, ["d0"]).orderBy("comp").collect()] == [-1.0, 5.0, -3.0]
