"""Range queries: one predicate tree, read two ways, and its XML and JSON forms.

``on_interval`` asks what a block's statistics allow (the block may hold a
match); ``on_value`` asks a value itself. A query first keeps the blocks that
the first reading cannot exclude, then refines their cells by the second.
"""

from __future__ import annotations

import json
import operator
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import clip, overlap
from .selection import SelectionError


class QueryError(ValueError):
    """A query document that says nothing sensible."""


_VALUE = {"GT": operator.gt, "LT": operator.lt, "GE": operator.ge, "LE": operator.le, "EQ": operator.eq, "NE": operator.ne}
_INTERVAL = {
    "GT": lambda lo, hi, v: hi > v,
    "LT": lambda lo, hi, v: lo < v,
    "GE": lambda lo, hi, v: hi >= v,
    "LE": lambda lo, hi, v: lo <= v,
    "EQ": lambda lo, hi, v: (lo <= v) & (hi >= v),
    "NE": lambda lo, hi, v: ~((lo == v) & (hi == v)),
}


@dataclass(frozen=True)
class Leaf:
    op: str
    value: float

    def __post_init__(self):
        if self.op not in _VALUE:
            raise QueryError(f"no such comparison: {self.op}")

    def on_interval(self, low: Column, high: Column) -> Column:
        return _INTERVAL[self.op](low, high, F.lit(self.value))

    def on_value(self, value: Column) -> Column:
        return _VALUE[self.op](value, F.lit(self.value))


@dataclass(frozen=True)
class Tree:
    """AND of nothing is true, OR of nothing false."""

    relation: str
    items: tuple[Leaf | Tree, ...] = ()

    def __post_init__(self):
        if self.relation not in ("AND", "OR"):
            raise QueryError(f"no such relation: {self.relation}")

    def _fold(self, parts: list[Column]) -> Column:
        if not parts:
            return F.lit(self.relation == "AND")
        return reduce(operator.and_ if self.relation == "AND" else operator.or_, parts)

    def on_interval(self, low: Column, high: Column) -> Column:
        return self._fold([x.on_interval(low, high) for x in self.items])

    def on_value(self, value: Column) -> Column:
        return self._fold([x.on_value(value) for x in self.items])


@dataclass(frozen=True)
class RangeQuery:
    """A tree over one variable, within a box (empty: all of it)."""

    variable: str
    tree: Tree
    start: tuple[int, ...] = ()
    count: tuple[int, ...] = ()

    def check(self, rank: int) -> RangeQuery:
        if self.count and len(self.count) != rank:
            raise SelectionError(f"a box of rank {len(self.count)} for a variable of rank {rank}")
        return self

    def touched(self, blocks: DataFrame, dims: Sequence[str], keep_clipped: bool = True) -> DataFrame:
        """The blocks that may hold a match, their start_ and count_ columns clipped to the box."""
        self.check(len(dims))
        hits = blocks.where(self.tree.on_interval(F.col("min"), F.col("max")))
        for d, s, c in zip(dims, self.start, self.count, strict=False):
            hits = hits.where(overlap(F.col(f"start_{d}"), F.col(f"count_{d}"), F.lit(s), F.lit(c)))
        if self.count and keep_clipped:
            for d, s, c in zip(dims, self.start, self.count, strict=True):
                first, size = clip(F.col(f"start_{d}"), F.col(f"count_{d}"), F.lit(s), F.lit(c))
                hits = hits.withColumns({f"start_{d}": first.cast("long"), f"count_{d}": size.cast("long")})
        return hits

    def refine(self, cells: DataFrame, hits: DataFrame, dims: Sequence[str], value: str = "value") -> DataFrame:
        """The matching cells of the touched blocks."""
        cond = self.tree.on_value(F.col(value))
        for d, s, c in zip(dims, self.start, self.count, strict=False):
            cond = cond & (F.col(d) >= s) & (F.col(d) < s + c)
        return cells.where(cond).join(hits.select("step", "block_id"), ["step", "block_id"], "left_semi")


@dataclass(frozen=True)
class CompositeQuery:
    """Range queries of several variables, combined by block."""

    relation: str
    parts: tuple[RangeQuery | CompositeQuery, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.relation not in ("AND", "OR"):
            raise QueryError(f"queries combine by AND or OR, not {self.relation}")

    def touched(self, blocks: dict[str, DataFrame], dims: Sequence[str]) -> DataFrame:
        """(step, block_id) with boxes: those in all parts, cut to the common box; or those of any part, each box once."""
        boxes = [f"{p}_{d}" for d in dims for p in ("start", "count")]
        found = [(p.touched(blocks[p.variable], dims) if isinstance(p, RangeQuery) else p.touched(blocks, dims)).select("step", "block_id", *boxes) for p in self.parts]
        if self.relation == "OR":
            return reduce(DataFrame.unionByName, found).distinct()
        out = found[0]
        for other in found[1:]:
            right = other.select("step", "block_id", *(F.col(b).alias(f"r_{b}") for b in boxes))
            out = out.join(right, ["step", "block_id"])
            for d in dims:
                first, size = clip(F.col(f"start_{d}"), F.col(f"count_{d}"), F.col(f"r_start_{d}"), F.col(f"r_count_{d}"))
                out = out.withColumns({f"start_{d}": first, f"count_{d}": size}).where(F.col(f"count_{d}") > 0)
            out = out.select("step", "block_id", *boxes)
        return out


def move_region(hits: DataFrame, dims: Sequence[str], reference: Sequence[int], output: Sequence[int]) -> DataFrame:
    """Hit boxes moved from the reference region's start to the output region's."""
    return hits.withColumns({f"start_{d}": F.col(f"start_{d}") + (o - r) for d, r, o in zip(dims, reference, output, strict=True)})


def _ints(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in str(text).split(",") if x.strip())


def _number(text: str) -> float:
    try:
        return float(text)
    except (TypeError, ValueError) as e:
        raise QueryError(f"not a number: {text!r}") from e


def _xml_tree(node: ET.Element) -> Tree:
    items: list[Leaf | Tree] = [Leaf(r.get("compare", ""), _number(r.get("value"))) for r in node.findall("range")]
    return Tree(node.get("value", ""), tuple([*items, *map(_xml_tree, node.findall("op"))]))


def _xml_variable(node: ET.Element) -> RangeQuery:
    op, box = node.find("op"), node.find("boundingbox")
    if not node.get("name") or op is None:
        raise QueryError("a variable needs a name and an op")
    start, count = (_ints(box.get(k, "")) for k in ("start", "count")) if box is not None else ((), ())
    return RangeQuery(node.get("name"), _xml_tree(op), start, count)


def from_xml(text: str, io: str | None = None) -> RangeQuery | CompositeQuery:
    """The query of an XML document; ``io`` is the name that it must address."""
    root = ET.fromstring(text)
    node = root.find("io")
    if node is None or io is not None and node.get("name") != io:
        raise QueryError(f"no io node named {io}" if io else "no io node")
    tags = {t.get("name"): _xml_variable(v) for t in node.findall("tag") if (v := t.find("var")) is not None}

    def combined(q: ET.Element) -> CompositeQuery:
        parts = [tags[c.get("tag") or c.get("name")] for c in q.findall("comp")] + [combined(c) for c in q.findall("query")]
        return CompositeQuery(q.get("op", ""), tuple(parts))

    if (q := node.find("query")) is not None:
        return combined(q)
    if (v := node.find("var")) is None:
        raise QueryError("no var and no query")
    return _xml_variable(v)


def _json_tree(node: dict) -> Tree:
    if "value" not in node:
        raise QueryError("an op needs a value")
    inner = node.get("op", [])
    ranges = node.get("range", [])
    leaves = [Leaf(r["compare"], _number(r["value"])) for r in (ranges if isinstance(ranges, list) else [ranges])]
    return Tree(node["value"], tuple([*leaves, *map(_json_tree, inner if isinstance(inner, list) else [inner])]))


def _json_variable(node: dict) -> RangeQuery:
    if "name" not in node or "op" not in node:
        raise QueryError("a variable needs a name and an op")
    box = node.get("boundingbox", {})
    return RangeQuery(node["name"], _json_tree(node["op"]), _ints(box.get("start", "")), _ints(box.get("count", "")))


def from_json(text: str, io: str | None = None) -> RangeQuery | CompositeQuery:
    """The query of a JSON document."""
    node = json.loads(text).get("io")
    if not isinstance(node, dict) or io is not None and node.get("name") != io:
        raise QueryError(f"no io node named {io}" if io else "no io node")
    if "query" in node:
        tags = {t["name"]: _json_variable(t["var"]) for t in node.get("tag", [])}
        comp = node["query"].get("comp", [])
        return CompositeQuery(node["query"].get("op", ""), tuple(tags[c] for c in comp))
    if "var" not in node:
        raise QueryError("no var and no query")
    return _json_variable(node["var"])


def from_file(path: str, io: str | None = None) -> RangeQuery | CompositeQuery:
    with open(path) as f:
        text = f.read()
    if path.endswith(".xml"):
        return from_xml(text, io)
    if path.endswith(".json"):
        return from_json(text, io)
    raise QueryError(f"neither XML nor JSON: {path}")
