"""Element types, their Spark types, and the widening rules of mixed expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ElementType:
    name: str
    size: int
    kind: str  # 'int', 'uint', 'float', 'complex', 'string', 'char', 'struct'
    spark: T.DataType
    has_minmax: bool


def complex_type(part: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("re", part), T.StructField("im", part)])


TYPES = {
    t.name: t
    for t in (
        ElementType("int8", 1, "int", T.ByteType(), True),
        ElementType("int16", 2, "int", T.ShortType(), True),
        ElementType("int32", 4, "int", T.IntegerType(), True),
        ElementType("int64", 8, "int", T.LongType(), True),
        ElementType("uint8", 1, "uint", T.ShortType(), True),
        ElementType("uint16", 2, "uint", T.IntegerType(), True),
        ElementType("uint32", 4, "uint", T.LongType(), True),
        ElementType("uint64", 8, "uint", T.DecimalType(20, 0), True),
        ElementType("float", 4, "float", T.FloatType(), True),
        ElementType("double", 8, "float", T.DoubleType(), True),
        ElementType("long double", 16, "float", T.DoubleType(), True),
        ElementType("float complex", 8, "complex", complex_type(T.FloatType()), False),
        ElementType("double complex", 16, "complex", complex_type(T.DoubleType()), False),
        ElementType("string", 0, "string", T.StringType(), False),
        ElementType("char", 1, "char", T.ByteType(), False),
    )
}
_OF_SPARK = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "decimal(20,0)": "uint64", "string": "string"}


class PromotionError(TypeError):
    """Two element types without a common type."""


def of_spark(kind: T.DataType) -> ElementType:
    """The element type that a Spark column stands for by default."""
    if kind == complex_type(T.FloatType()):
        return TYPES["float complex"]
    if kind == complex_type(T.DoubleType()):
        return TYPES["double complex"]
    name = _OF_SPARK.get(kind.simpleString())
    if name is None:
        raise PromotionError(f"no element type for {kind.simpleString()}")
    return TYPES[name]


def promote(a: str, b: str, strict: bool = False) -> str:
    """The type of an operation on ``a`` and ``b``: the larger; of one size, float over integer and unsigned over signed.

    Where a 64-bit integer outweighs a float, or signs are mixed, nothing
    converts: ``strict`` raises, and otherwise the result is double.
    """
    x, y = TYPES[a], TYPES[b]
    if x == y:
        return a
    rank = {"int": 0, "uint": 1, "float": 2, "complex": 3}
    if x.kind not in rank or y.kind not in rank:
        raise PromotionError(f"{a} and {b} have no common type")
    top, low = sorted((x, y), key=lambda t: (t.size, rank[t.kind]), reverse=True)
    converts = low.kind == top.kind or top.kind in ("float", "complex") and low.kind != "complex"
    if converts:
        return top.name
    if strict:
        raise PromotionError(f"no conversion from {low.name} to {top.name}")
    return "double"
