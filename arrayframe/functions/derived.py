"""Derived variables: expression trees compiled to columns, reductions and reshapes to DataFrame steps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, mul, sub

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import TYPES, of_spark, promote
from .parser import Call, Expression, ExpressionError, Name, Number, parse, variables
from .stencil import curl_components, trimmed, widened

REDUCERS, RESHAPERS = ("add", "magnitude"), ("cross", "cross_std", "curl")
#: The column that numbers the component planes of an array of vectors.
COMPONENT = "comp"


@dataclass(frozen=True)
class Typed:
    column: Column
    type: str  # of the element, or 'number' for a literal


def ieee_div(a: Column, b: Column) -> Column:
    """Floating division with infinities and NaN where b is 0, by the sign of that zero; null where either is null."""
    negative = b.cast("string").startswith("-")  # asked of zeros alone: only their text tells them apart
    zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when((a > 0) != negative, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b != 0, F.try_divide(a, b)).when(a.isNotNull() & b.isNotNull(), zero)


def _cast(x: Typed, to: str) -> Column:
    kind = TYPES[to]
    if x.type == "number":
        # next to integers a literal counts as an integer
        return F.lit(int(x.column) if kind.kind in ("int", "uint") else float(x.column)).cast(kind.spark)
    return x.column.cast(kind.spark) if x.type != to else x.column


def _common(args: Sequence[Typed], strict: bool) -> str:
    kinds = [a.type for a in args if a.type != "number"]
    return reduce(lambda a, b: promote(a, b, strict), kinds) if kinds else "double"


def _real(args: Sequence[Typed], strict: bool) -> str:
    """Floats stay; integers become double."""
    kind = _common(args, strict)
    return kind if TYPES[kind].kind == "float" else "double"


def compile_node(node: Expression, inputs: dict[str, Typed], strict: bool = False) -> Typed:
    """The elementwise column of ``node``; reductions were replaced before."""
    if isinstance(node, Number):
        return Typed(node.value, "number")  # type: ignore[arg-type]
    if isinstance(node, Name):
        if node.name not in inputs:
            raise ExpressionError(f"no variable {node.name}")
        return inputs[node.name]
    args = [compile_node(a, inputs, strict) for a in node.args]
    name = node.function
    if name in ("add", "subtract", "multiply"):
        kind = _common(args, strict)
        return Typed(reduce({"add": add, "subtract": sub, "multiply": mul}[name], [_cast(a, kind) for a in args]), kind)
    if name == "divide":
        kind = _common(args, strict)
        first, *rest = (_cast(a, kind) for a in args)
        if TYPES[kind].kind == "float":
            return Typed(ieee_div(first, reduce(mul, rest)), kind)
        by = reduce(mul, rest)
        whole = F.when(by != 0, F.call_function("div", first, by))
        return Typed(whole.cast(TYPES[kind].spark), kind)
    if name == "negate":
        if TYPES[args[0].type].kind == "uint":
            raise ExpressionError("unsigned values have no negative")
        return Typed(-args[0].column, args[0].type)
    if name == "pow":
        square = len(args) == 1 or args[1].type == "number" and float(args[1].column) == 2.0
        if square and args[0].type != "number":
            return Typed(args[0].column * args[0].column, args[0].type)
        kind = _real(args, strict)
        return Typed(F.pow(*(_cast(a, kind) for a in args)).cast(TYPES[kind].spark), kind)
    if name == "magnitude":
        kind = _real(args, strict)
        parts = [_cast(a, kind) for a in args]
        return Typed(F.sqrt(reduce(add, (p * p for p in parts))).cast(TYPES[kind].spark), kind)
    kind = _real(args, strict)
    return Typed(getattr(F, name)(_cast(args[0], kind)).cast(TYPES[kind].spark), kind)


def inputs_of(frame: DataFrame, names: Sequence[str], columns: dict[str, str] | None = None) -> dict[str, Typed]:
    """Variables of a wide frame: each name is a column, or ``columns`` says which."""
    columns = columns or {}
    return {n: Typed(F.col(f"`{columns.get(n, n)}`"), of_spark(frame.schema[columns.get(n, n)].dataType).name) for n in names}


def column(expression: str, frame: DataFrame, columns: dict[str, str] | None = None, strict: bool = False) -> Column:
    """An elementwise expression as a column of ``frame``."""
    tree = parse(expression)
    return compile_node(tree, inputs_of(frame, variables(tree), columns), strict).column


def _reductions(node: Expression, dims: Sequence[str], found: list[Call]) -> Expression:
    """The tree with one-argument sums and magnitudes replaced by names of columns to be aggregated."""
    if not isinstance(node, Call):
        return node
    if node.function in REDUCERS and len(node.args) == 1 and not isinstance(node.args[0], Number):
        found.append(node)
        return Name(f"__r{len(found) - 1}")
    return Call(node.function, tuple(_reductions(a, dims, found) for a in node.args))


def derive(frame: DataFrame, expression: str, dims: Sequence[str], name: str = "value", keys: Sequence[str] = ("step",), columns: dict[str, str] | None = None, block: Sequence[str] = ("block_id",), strict: bool = False) -> DataFrame:
    """The derived variable of ``expression`` over a wide frame: keys, its dimensions, and ``name``.

    A sum or magnitude of one argument reduces the last dimension; cross and
    curl add a last dimension ``comp`` of 3.
    """
    tree = parse(expression)
    if isinstance(tree, Call) and tree.function in RESHAPERS:
        return _reshaped(frame, tree, dims, name, keys, columns, block, strict)
    found: list[Call] = []
    outer = _reductions(tree, dims, found)
    if not found:
        value = compile_node(tree, inputs_of(frame, variables(tree), columns), strict).column
        return frame.select(*keys, *dims, value.alias(name))
    if loose := [v for v in variables(outer) if not v.startswith("__r")]:
        raise ExpressionError(f"{', '.join(loose)} and a reduced value differ in shape")
    kept = [*keys, *dims[:-1]]
    aggregates = []
    for i, call in enumerate(found):
        x = compile_node(call.args[0], inputs_of(frame, variables(call.args[0]), columns), strict)
        wide = x.column.cast("double") if TYPES[x.type].kind == "float" or call.function == "magnitude" else x.column
        total = F.sum(wide) if call.function == "add" else F.sqrt(F.sum(wide * wide))
        aggregates.append(total.alias(f"__r{i}"))
    small = frame.groupBy(*kept).agg(*aggregates)
    value = compile_node(outer, inputs_of(small, variables(outer)), strict).column
    return small.select(*kept, value.alias(name))


def output_dims(expression: str, dims: Sequence[str]) -> list[str]:
    """The dimensions of the derived variable: one less after a reduction, one more after cross and curl."""
    tree = parse(expression)
    if isinstance(tree, Call) and tree.function in RESHAPERS:
        return [*dims, COMPONENT]
    found: list[Call] = []
    _reductions(tree, dims, found)
    return list(dims[:-1] if found else dims)


def is_elementwise(expression: str) -> bool:
    """Whether each cell's value comes from that cell alone."""
    tree, found = parse(expression), []
    _reductions(tree, (), found)
    return not found and not (isinstance(tree, Call) and tree.function in RESHAPERS)


def derive_box(frame: DataFrame, expression: str, dims: Sequence[str], start: Sequence[int], count: Sequence[int], **options) -> DataFrame:
    """The derived variable in a box of its own dimensions.

    The box narrows what is read, by one cell more on each side for a stencil; a
    box without the component dimension takes all components.
    """
    out, tree = output_dims(expression, dims), parse(expression)
    if len(start) not in (len(out), len([d for d in out if d != COMPONENT or d in dims])):
        raise ExpressionError(f"a box of rank {len(start)} for a variable of rank {len(out)}")
    halo = 1 if isinstance(tree, Call) and tree.function == "curl" else 0
    inner = [(d, s, c) for d, s, c in zip(out, start, count, strict=False) if d in dims]
    names, low, size = ([x[i] for x in inner] for i in range(3))
    found = derive(widened(frame, names, low, size, halo), expression, dims, **options)
    return trimmed(found, out[: len(start)], start, count)


def _reshaped(frame: DataFrame, tree: Call, dims: Sequence[str], name: str, keys: Sequence[str], columns: dict[str, str] | None, block: Sequence[str], strict: bool) -> DataFrame:
    args = [compile_node(a, inputs_of(frame, variables(a), columns), strict) for a in tree.args]
    kind = _real(args, strict)
    fields = [_cast(a, kind) for a in args]
    if tree.function == "curl":
        within = list(dict.fromkeys([*keys, *block]))
        if len(fields) == 1:
            # one array of three component planes: the planes side by side
            if COMPONENT not in frame.columns:
                raise ExpressionError(f"curl of one array needs its component in a column {COMPONENT}")
            plane = frame.select(*within, *dims, COMPONENT, fields[0].alias("__f"))
            parts = plane.groupBy(*within, *dims).agg(*(F.max(F.when(F.col(COMPONENT) == i, F.col("__f"))).alias(f"__f{i}") for i in range(3)))
        else:
            parts = frame.select(*within, *dims, *(f.alias(f"__f{i}") for i, f in enumerate(fields)))
        # one shuffle by block serves the windows along all dimensions
        comps = curl_components(parts.repartition(*within) if block else parts, dims, ["__f0", "__f1", "__f2"], within)
    else:
        ax, ay, az, bx, by, bz = fields
        middle = ax * bz - az * bx if tree.function == "cross" else az * bx - ax * bz
        comps = frame.select(*keys, *dims, F.array(ay * bz - az * by, middle, ax * by - ay * bx).alias("__v"))
    return comps.select(*keys, *dims, F.posexplode("__v").alias("comp", name)).withColumn("comp", F.col("comp").cast("long"))


def store(frame: DataFrame, expression: str, dims: Sequence[str], kind: str = "store", **options) -> DataFrame:
    """A derived variable as it is kept: 'expression' (lazy), 'store' (lazy here, for a sink), or 'stats' (extremes of each key)."""
    out = derive(frame, expression, dims, **options)
    if kind in ("expression", "store"):
        return out
    if kind != "stats":
        raise ValueError(f"no such kind: {kind}")
    name, keys = options.get("name", "value"), options.get("keys", ("step",))
    return out.groupBy(*keys).agg(F.min(name).alias("min"), F.max(name).alias("max"))
