"""Selections: which steps, which block, which box of a variable, as predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectionError(ValueError):
    """A selection that does not fit its variable."""


@dataclass(frozen=True)
class Selection:
    """Everything by default; ``with_*`` return narrowed copies."""

    start: tuple[int, ...] = ()
    count: tuple[int, ...] = ()
    block: int | None = None
    steps: tuple[int, int] | None = None
    memory: tuple[tuple[int, ...], tuple[int, ...]] | None = None
    accuracy: tuple[float, float, bool] | None = None  # error, norm, relative

    @classmethod
    def all(cls) -> Selection:
        return cls()

    @classmethod
    def bounding_box(cls, start: Sequence[int], count: Sequence[int]) -> Selection:
        return cls().with_box(start, count)

    def with_box(self, start: Sequence[int], count: Sequence[int]) -> Selection:
        if len(start) != len(count):
            raise SelectionError("start and count differ in rank")
        if any(x < 0 for x in (*start, *count)):
            raise SelectionError("start and count are not negative")
        return replace(self, start=tuple(start), count=tuple(count))

    def with_block(self, block: int) -> Selection:
        return replace(self, block=block)

    def with_steps(self, start: int, count: int) -> Selection:
        if count < 1:
            raise SelectionError("at least one step")
        return replace(self, steps=(start, count))

    def with_memory(self, start: Sequence[int], count: Sequence[int]) -> Selection:
        if len(start) != len(count) or self.count and any(s + c > m for s, c, m in zip(start, self.count, count, strict=True)):
            raise SelectionError("the memory box does not hold the selection")
        return replace(self, memory=(tuple(start), tuple(count)))

    def with_accuracy(self, error: float, norm: float = float("inf"), relative: bool = False) -> Selection:
        return replace(self, accuracy=(error, norm, relative))

    def clear(self, *names: str) -> Selection:
        """Without the named parts: box, block, steps, memory or accuracy."""
        blank = Selection()
        fields = {f for n in names for f in (("start", "count") if n == "box" else (n,))}
        return replace(self, **{f: getattr(blank, f) for f in fields})

    def __str__(self) -> str:
        parts = [f"box start {list(self.start)} count {list(self.count)}" if self.count else "all"]
        if self.block is not None:
            parts.append(f"block {self.block}")
        if self.steps:
            parts.append(f"steps {self.steps[0]}+{self.steps[1]}")
        return f"Selection({', '.join(parts)})"

    def check(self, shape: Sequence[int]) -> Selection:
        """Itself, if its box lies within ``shape``: boxes are never clipped."""
        if self.count and len(self.count) != len(shape):
            raise SelectionError(f"a box of rank {len(self.count)} for a shape of rank {len(shape)}")
        for s, c, n in zip(self.start, self.count, shape, strict=False):
            if s + c > n:
                raise SelectionError(f"the box ends at {s + c}, the shape at {n}")
        return self

    def size(self, shape: Sequence[int]) -> int:
        """Elements of the box (else the shape), times the steps."""
        return reduce(mul, self.count or tuple(shape), 1) * (self.steps[1] if self.steps else 1)

    def condition(self, dims: Sequence[str], origin: Sequence[str] = ()) -> Column:
        """The selection over cells. With a block, the box is relative to the block's ``origin`` columns."""
        conds = []
        if self.steps:
            conds.append((F.col("step") >= self.steps[0]) & (F.col("step") < self.steps[0] + self.steps[1]))
        if self.block is not None:
            conds.append(F.col("block_id") == self.block)
        if self.count and len(self.count) != len(dims):
            raise SelectionError(f"a box of rank {len(self.count)} for {len(dims)} dimensions")
        for i, (s, c) in enumerate(zip(self.start, self.count, strict=True)):
            d = F.col(dims[i]) - F.col(origin[i]) if self.block is not None and origin else F.col(dims[i])
            conds.append((d >= s) & (d < s + c))
        return reduce(and_, conds) if conds else F.lit(True)

    def apply(self, cells: DataFrame, dims: Sequence[str], origin: Sequence[str] = ()) -> DataFrame:
        return cells.where(self.condition(dims, origin))


def from_dump(start: Sequence[int], count: Sequence[int], shape: Sequence[int]) -> Selection:
    """The list tool's slice: step first, negative starts count from the end, count -1 runs to the end."""
    if len(start) != len(shape) or len(count) != len(shape):
        raise SelectionError("a slice names the step and every dimension")
    begin = [s + n if s < 0 else s for s, n in zip(start, shape, strict=True)]
    size = [n - b if c == -1 else c for b, c, n in zip(begin, count, shape, strict=True)]
    out = Selection().with_steps(begin[0], size[0])
    return out.with_box(begin[1:], size[1:]).check(shape[1:]) if len(shape) > 1 else out


def memory_buffer(cells: DataFrame, selection: Selection, dims: Sequence[str], fill: float = 0.0, value: str = "value") -> DataFrame:
    """The selection's memory box for each step: (step, m0, m1, ..., value), with ``fill`` around the selected cells.

    The grid is made of the steps and index ranges alone; cells are joined to it.
    """
    if not selection.count or selection.memory is None:
        raise SelectionError("a buffer needs a box and a memory box")
    offset, size = selection.memory
    grid = cells.select("step").distinct()
    for i, n in enumerate(size):
        grid = grid.withColumn(f"m{i}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    names = [f"m{i}" for i in range(len(size))]
    moved = [(F.col(d) - s + o).alias(m) for d, s, o, m in zip(dims, selection.start, offset, names, strict=True)]
    inside = selection.apply(cells, dims).select("step", *moved, value)
    return grid.join(inside, ["step", *names], "left").select("step", *names, F.coalesce(value, F.lit(fill)).alias(value))


def ghost_cells(cells: DataFrame, selection: Selection, dim: str, before: int, after: int, fill: float = 0.0, value: str = "value") -> DataFrame:
    """A one-dimensional box with ``before`` and ``after`` cells of ``fill`` at its ends."""
    (count,) = selection.count
    return memory_buffer(cells, selection.with_memory([before], [before + count + after]), [dim], fill, value)
