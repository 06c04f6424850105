"""A Spark data source of arrays by formula: an engine plugin in the Python Data Source API.

``spark.read.format("arrayformula").options(shape="100,50", steps="3", blocks="4").load()``
gives cells (step, block_id, d0, ..., value) with value = 1000 step + the
row-major index; each partition makes one block of one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FormulaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrayformula"

    def schema(self) -> str:
        rank = len(self.options.get("shape", "10").split(","))
        return ", ".join(["step bigint", "block_id bigint", *(f"d{i} bigint" for i in range(rank)), "value double"])

    def reader(self, schema) -> DataSourceReader:
        return FormulaReader([int(x) for x in self.options.get("shape", "10").split(",")], int(self.options.get("steps", "1")), int(self.options.get("blocks", "1")))


class FormulaReader(DataSourceReader):
    def __init__(self, shape: list[int], steps: int, blocks: int):
        self.shape, self.steps, self.blocks = shape, steps, blocks

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((s, b)) for s in range(self.steps) for b in range(self.blocks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        step, block = partition.value
        size = self.shape[0] // self.blocks
        first = size * block
        last = self.shape[0] if block == self.blocks - 1 else first + size
        inner = int(np.prod(self.shape[1:]))
        for row in range(first, last):
            at = np.arange(row * inner, (row + 1) * inner)
            index = np.unravel_index(at, self.shape)
            columns = [np.full(inner, step), np.full(inner, block), *index, 1000.0 * step + at]
            names = ["step", "block_id", *(f"d{i}" for i in range(len(self.shape))), "value"]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64 if n == "value" else np.int64)) for n, c in zip(names, columns, strict=True)], names=names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FormulaSource)
