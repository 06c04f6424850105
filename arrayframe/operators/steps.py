"""Step selections: the step filter language, renumbering, step maps and gaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StepRule:
    first: int
    last: int | None  # None: without end
    stride: int = 1

    def holds(self, step: int) -> bool:
        return step >= self.first and (self.last is None or step <= self.last) and (step - self.first) % self.stride == 0

    def column(self, step: Column) -> Column:
        cond = step >= self.first
        if self.last is not None:
            cond = cond & (step <= self.last)
        return cond & ((step - self.first) % self.stride == 0) if self.stride > 1 else cond


def parse_steps(text: str) -> list[StepRule]:
    """Rules ``i``, ``i:j`` and ``i:j:k`` between blanks, ends included; ``n`` as the end means none."""
    rules = []
    for item in text.split():
        parts = item.split(":")
        if len(parts) > 3 or not all(p.isdigit() for i, p in enumerate(parts) if not (i == 1 and p in ("n", "N"))):
            raise ValueError(f"not a step rule: {item!r}")
        first = int(parts[0])
        last = first if len(parts) == 1 else None if parts[1] in ("n", "N") else int(parts[1])
        stride = int(parts[2]) if len(parts) == 3 else 1
        if stride < 1:
            raise ValueError(f"a stride of 0: {item!r}")
        rules.append(StepRule(first, last, stride))
    return rules


def is_selected(rules: list[StepRule], step: int) -> bool:
    return not rules or any(r.holds(step) for r in rules)


def step_condition(text: str, step: Column) -> Column:
    """The filter as a predicate over ``step``; it reaches the scan, and prunes step partitions."""
    rules = parse_steps(text)
    return reduce(or_, (r.column(step) for r in rules)) if rules else F.lit(True)


def step_map(frame: DataFrame, step: str = "step") -> DataFrame:
    """(step, relative): the position of each present step. The window runs over distinct steps alone."""
    return frame.select(step).distinct().withColumn("relative", (F.row_number().over(Window.orderBy(step)) - 1).cast("long"))


def select_steps(frame: DataFrame, text: str, step: str = "step", renumber: bool = True) -> DataFrame:
    """The frame's selected steps, numbered from 0 where asked."""
    kept = frame.where(step_condition(text, F.col(step)))
    if not renumber:
        return kept
    return kept.join(step_map(kept, step), step).drop(step).withColumnRenamed("relative", step).select(*frame.columns)


def relative_steps(frame: DataFrame, start: int, count: int, step: str = "step") -> DataFrame:
    """The ``count`` present steps from the ``start``-th on."""
    wanted = step_map(frame, step).where((F.col("relative") >= start) & (F.col("relative") < start + count)).select(step)
    return frame.join(wanted, step, "left_semi")


def append_after(kept: DataFrame, added: DataFrame, n: int, step: str = "step") -> DataFrame:
    """``kept``'s first ``n`` steps (from the end where negative), then ``added``'s steps numbered on."""
    steps = step_map(kept, step)
    total = steps.agg(F.count("*")).scalar()
    limit = F.greatest(F.lit(0), total + n + 1) if n < 0 else F.least(total, F.lit(n))
    old = kept.join(steps.where(F.col("relative") < limit).select(step), step, "left_semi")
    base = old.agg(F.coalesce(F.max(step), F.lit(-1)) + 1).scalar()
    new = added.join(step_map(added, step), step).withColumn(step, base + F.col("relative")).select(*kept.columns)
    return old.unionByName(new)


def flatten_steps(frame: DataFrame, blocks_per_step: int, step: str = "step") -> DataFrame:
    """All steps as one: step 0, and blocks numbered on from step to step."""
    return frame.withColumn("block_id", F.col(step) * blocks_per_step + F.col("block_id")).withColumn(step, F.lit(0).cast("long"))


def step_gaps(frame: DataFrame, step: str = "step") -> DataFrame:
    """(step, previous) wherever steps are missing between two present ones."""
    along = Window.orderBy(step)
    return frame.select(step).distinct().withColumn("previous", F.lag(step).over(along)).where(F.col(step) != F.col("previous") + 1)
