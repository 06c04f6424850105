"""The facade: contexts, IOs, streams and file readers over DataFrames."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.derived import column, derive, derive_box, is_elementwise, output_dims
from .functions.parser import parse, variables
from .operators.layout import quantize
from .operators.predicates import RangeQuery
from .operators.selection import Selection
from .operators.stats import block_stats, merge_stats
from .shapes import ShapeKind, change, infer
from .sources import engines
from .sources.catalog import attributes_frame, available_attributes, current_attributes
from .streaming.status import StepError, StepStatus


#: What is kept of a derived variable: its values, the extremes of its blocks, or the expression alone.
KINDS = ("store", "stats", "expression")
#: Folders of a store beside its cells; readers of cells pass them over.
ATTRIBUTES, DERIVED, END = "_attributes", "_derived", "_end"


class DefinitionError(ValueError):
    """A name defined twice, unknown, or of another type."""


@dataclass
class Variable:
    name: str
    type: str
    shape: tuple[int, ...] = ()
    start: tuple[int, ...] = ()
    count: tuple[int, ...] = ()
    constant: bool = False
    kind: ShapeKind = field(init=False)

    def __post_init__(self):
        self.kind = infer(self.shape, self.start, self.count, self.type == "string")

    def set_shape(self, shape: Sequence[int]) -> None:
        self.shape = change(self.shape, shape, self.kind, self.constant)

    def selection(self) -> Selection:
        """What the variable's own start and count select: all of it where it has none."""
        if not self.count:
            return Selection()
        return Selection().with_box(self.start or (0,) * len(self.count), self.count)


@dataclass
class IO:
    """A namespace of definitions, with an engine and its parameters; it holds no data."""

    name: str
    engine: str = "parquet"
    parameters: dict[str, str] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    derived: dict[str, tuple[str, str]] = field(default_factory=dict)
    attributes: list[tuple] = field(default_factory=list)
    modifiable: dict[str, str] = field(default_factory=dict)

    def set_engine(self, name: str) -> None:
        self.engine = name
        self.parameters |= engines.PRESETS.get(name.lower(), {})

    def define_variable(self, name: str, type: str, shape: Sequence[int] = (), start: Sequence[int] = (), count: Sequence[int] = (), constant: bool = False) -> Variable:
        if name in self.variables or name in self.derived:
            raise DefinitionError(f"{name} is defined")
        self.variables[name] = Variable(name, type, tuple(shape), tuple(start), tuple(count), constant)
        return self.variables[name]

    def inquire_variable(self, name: str, type: str | None = None) -> Variable | None:
        found = self.variables.get(name)
        return found if found is not None and (type is None or found.type == type) else None

    def define_derived_variable(self, name: str, expression: str, kind: str = "store") -> None:
        if name in self.variables or name in self.derived:
            raise DefinitionError(f"{name} is defined")
        if missing := [v for v in variables(parse(expression)) if v not in self.variables]:
            raise DefinitionError(f"unknown: {', '.join(missing)}")
        if kind not in KINDS:
            raise DefinitionError(f"no such kind: {kind}")
        self.derived[name] = (expression, kind)

    def define_attribute(self, name: str, value: object, type: str = "string", variable: str = "", separator: str = "/", modifiable: bool = False, step: int = 0) -> None:
        full = f"{variable}{separator}{name}" if variable else name
        known = [a for a in self.attributes if a[0] == full]
        if known and (full not in self.modifiable or self.modifiable[full] != type):
            raise DefinitionError(f"attribute {full} can not change")
        if modifiable:
            self.modifiable[full] = type
        self.attributes.append((full, type, value, step))

    def remove_variable(self, name: str) -> bool:
        return self.variables.pop(name, None) is not None


class Context:
    """A session and its IOs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.ios = spark, {}

    def declare_io(self, name: str) -> IO:
        if name in self.ios:
            raise DefinitionError(f"IO {name} is declared")
        self.ios[name] = IO(name)
        return self.ios[name]

    def at_io(self, name: str) -> IO:
        if name not in self.ios:
            raise DefinitionError(f"no IO {name}")
        return self.ios[name]


class FileReader:
    """Random access to a store of wide cells: step, block_id, index columns, a column for each variable."""

    def __init__(self, spark: SparkSession, path: str, dims: Sequence[str], engine: str | None = None, **options: str):
        self.spark, self.dims, self.path = spark, list(dims), path
        self.cells = engines.read(spark, path, engine, **options)
        # renumbered or flattened steps are not those of the kept statistics
        self.stored = not options and (engine or engines.detect(spark, path)).lower() in engines.STORES
        self.derived: dict[str, str] = {}
        #: derived variables whose values have a store of their own, as their shape is another
        self.kept: dict[str, str] = {}
        if self.stored and engines.exists(spark, f"{path}/{DERIVED}/definitions"):
            for r in spark.read.parquet(f"{path}/{DERIVED}/definitions").collect():  # a row for each derived variable
                self.derived[r.name] = r.expression
                if r.folder:
                    self.kept[r.name] = f"{path}/{DERIVED}/{r.folder}"

    def variables(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("step", "block_id", "writer", *self.dims)] + list(self.derived)

    def define_derived_variable(self, name: str, expression: str) -> None:
        """Parsed now, computed when read."""
        if name in self.variables():
            raise DefinitionError(f"{name} is defined")
        if missing := [v for v in variables(parse(expression)) if v not in self.variables()]:
            raise DefinitionError(f"unknown: {', '.join(missing)}")
        self.derived[name] = expression

    def read(self, name: str, selection: Selection = Selection()) -> DataFrame:  # noqa: B008 - immutable
        """step, index and value of the selected cells, within the selection's accuracy if it asks for one."""
        if name in self.derived:
            out = self._derived(name, selection)
        elif name in self.variables():
            out = selection.apply(self.cells.select("step", "block_id", *self.dims, F.col(name).alias("value")), self.dims)
        else:
            raise DefinitionError(f"no variable {name}")
        if selection.accuracy is not None and selection.accuracy[0] > 0:
            error, _, relative = selection.accuracy
            out = out.withColumn("value", quantize(F.col("value").cast("double"), error, F.abs("value") if relative else None))
        return out

    def _derived(self, name: str, selection: Selection) -> DataFrame:
        """Its box is one of the derived variable's own dimensions; it narrows what is read of the inputs."""
        expression, keys = self.derived[name], ("step", "block_id")
        dims = output_dims(expression, self.dims)
        if name in self.kept:
            found = engines.read(self.spark, self.kept[name]).select(*keys, *dims, "value")
            return selection.apply(found, dims if not selection.count else dims[: len(selection.count)])
        if not selection.count:
            return selection.apply(derive(self.cells, expression, self.dims, "value", keys), dims)
        return selection.clear("box").apply(derive_box(self.cells, expression, self.dims, selection.start, selection.count, name="value", keys=keys), dims)

    def num_steps(self) -> int:
        return self.cells.select("step").distinct().count()

    def blocks(self, name: str) -> DataFrame:
        """The variable's block statistics: those kept with the store, else computed from the cells."""
        kept = engines.read_blocks(self.spark, self.path, name) if self.stored else None
        dims = output_dims(self.derived[name], self.dims) if name in self.derived else self.dims
        return kept if kept is not None else block_stats(self.read(name), dims)

    def query(self, asked: RangeQuery) -> DataFrame:
        """The cells that match: the touched blocks by their statistics, then their cells."""
        cells = self.read(asked.variable)
        return asked.refine(cells, asked.touched(self.blocks(asked.variable), self.dims), self.dims)

    def minmax(self, name: str, step: int | None = None) -> DataFrame:
        stats = self.blocks(name)
        return merge_stats(stats if step is None else stats.where(F.col("step") == step), ["step"] if step is not None else [])

    def attributes(self, variable: str = "") -> DataFrame:
        """Each attribute's last value; ``attribute_steps`` has all of them."""
        return available_attributes(current_attributes(self.attribute_steps()), variable)

    def attribute_steps(self) -> DataFrame:
        """All values that attributes were given, by step."""
        if self.stored and engines.exists(self.spark, f"{self.path}/{ATTRIBUTES}"):
            return self.spark.read.parquet(f"{self.path}/{ATTRIBUTES}")
        return attributes_frame(self.spark, [])


class Stream(FileReader):
    """A store step by step: ``for step in stream.steps(): stream.read(...)`` reads that step alone."""

    def __init__(self, *args, **options):
        super().__init__(*args, **options)
        self.current: int | None = None
        self.last: int | None = None

    def steps(self, most: int | None = None) -> Iterator[int]:
        present = self.cells.select("step").distinct().orderBy("step")
        for row in (present.limit(most) if most is not None else present).toLocalIterator():
            self.current = row[0]
            yield row[0]
        self.current = None

    def begin_step(self, timeout: float = 0.0, poll: float = 0.2) -> StepStatus:
        """Makes the next step current; waits up to ``timeout`` seconds for a writer that has not closed the store."""
        if self.current is not None:
            raise StepError(f"step {self.current} is not ended")
        until = time.monotonic() + timeout
        while True:
            closed = engines.exists(self.spark, f"{self.path}/{END}")  # before the steps: none appears after the end
            self.cells = engines.read(self.spark, self.path)
            later = self.cells.where(F.col("step") > self.last) if self.last is not None else self.cells
            if (found := later.agg(F.min("step")).first()[0]) is not None:
                self.current = found
                return StepStatus.OK
            if closed:
                return StepStatus.END_OF_STREAM
            if time.monotonic() >= until:
                return StepStatus.NOT_READY
            time.sleep(poll)

    def end_step(self) -> None:
        if self.current is None:
            raise StepError("no step is begun")
        self.last, self.current = self.current, None

    def read(self, name: str, selection: Selection = Selection()) -> DataFrame:  # noqa: B008 - immutable
        if self.current is not None:
            if selection.steps:
                raise DefinitionError("a stream has no step selection")
            selection = selection.with_steps(self.current, 1)
        return super().read(name, selection)


class StreamWriter:
    """Writes a store step by step; readers see a step once it is ended, and the end once the writer is closed."""

    def __init__(self, spark: SparkSession, path: str, io: IO | None = None, **options):
        self.spark, self.path, self.io, self.options = spark, path, io, options
        self.step, self.held = 0, None

    def begin_step(self) -> StepStatus:
        if self.held is not None:
            raise StepError(f"step {self.step} is not ended")
        self.held = []
        return StepStatus.OK

    def put(self, cells: DataFrame) -> None:
        """Cells without their step: block_id, index columns, a column for each variable."""
        if self.held is None:
            raise StepError("no step is begun")
        self.held.append(cells.select(F.lit(self.step).cast("long").alias("step"), *(F.col(f"`{c}`") for c in cells.columns if c != "step")))

    def end_step(self) -> None:
        if self.held is None:
            raise StepError("no step is begun")
        if self.held:
            write(reduce(DataFrame.unionByName, self.held), self.path, self.io, mode="append" if self.step else "write", **self.options)
        self.step, self.held = self.step + 1, None

    def close(self) -> None:
        if self.held is not None:
            raise StepError(f"step {self.step} is not ended")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/{END}")


def write(frame: DataFrame, path: str, io: IO | None = None, **options) -> None:
    """Writes wide cells through the IO's engine, with its attributes and derived variables.

    Stored derived values of the cells' shape become columns; others (reductions,
    cross, curl) get a store of their own beside, over the dimensions ``order``;
    of "stats" the block statistics are kept, of "expression" nothing but itself.
    """
    if io is None or io.engine.lower() not in engines.STORES | engines.STREAMS:
        return engines.write(frame, path, io.engine if io else "parquet", **options)
    dims, columns, stats, definitions, apart = list(options.get("order", ())), {}, [], [], {}
    for name, (expression, kind) in io.derived.items():
        same = is_elementwise(expression)
        if not same and kind != "expression" and not dims:
            raise DefinitionError(f"{name} needs the dimensions: order")
        folder = f"v{len(apart)}" if kind == "store" and not same else ""
        if kind == "store" and same:
            columns[name] = column(expression, frame)
        elif folder:
            apart[folder] = expression
        if kind == "stats":
            stats.append((name, block_stats(derive(frame, expression, dims, "value", ("step", "block_id")), output_dims(expression, dims))))
        if not (kind == "store" and same):
            definitions.append((name, expression, kind, folder))
    spark = frame.sparkSession
    engines.write(frame.withColumns(columns), path, io.engine, **options)
    more = {k: v for k, v in options.items() if k in ("mode", "append_after")}
    for folder, expression in apart.items():
        engines.write(derive(frame, expression, dims, "value", ("step", "block_id")), f"{path}/{DERIVED}/{folder}", order=tuple(output_dims(expression, dims)[:1]), **more)
    for name, found in stats:
        engines.add_blocks(found, path, name)
    if definitions:
        spark.createDataFrame(definitions, "name string, expression string, kind string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{DERIVED}/definitions")
    if io.attributes:
        attributes_frame(spark, io.attributes).coalesce(1).write.mode("overwrite").parquet(f"{path}/{ATTRIBUTES}")
