"""Data-reduction operators by name: what they do to a column, and which Parquet codec stores it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import quantize

#: Lossless codecs by the Parquet compression that takes their place; lossy ones bound the error by quantising.
LOSSLESS = {"bzip2": "zstd", "blosc": "lz4", "zlib": "gzip", "null": "uncompressed", "png": "zstd"}
LOSSY = frozenset(["zfp", "sz", "sz3", "mgard", "mgardplus", "mgard_complex", "bigwhoop", "mdr", "prodm"])
OUT_OF_SCOPE = frozenset(["caesar", "libpressio", "sirius"])
_REAL = ("float", "double")


class CodecError(ValueError):
    """A codec that does not exist, or parameters that exclude each other."""


@dataclass(frozen=True)
class Operation:
    codec: str
    parameters: dict[str, str] = field(default_factory=dict)

    def error(self) -> float | None:
        """The absolute or relative error that a lossy codec may make; None for lossless ones."""
        if self.codec not in LOSSY:
            return None
        given = [k for k in ("accuracy", "tolerance", "rate", "precision") if k in self.parameters]
        if len(given) != 1:
            raise CodecError(f"{self.codec} takes one of accuracy, rate and precision, not {given}")
        value = float(self.parameters[given[0]])
        if value <= 0:
            raise CodecError(f"{given[0]} is positive")
        return value if given[0] in ("accuracy", "tolerance") else 2.0**-value


_plugins: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register_codec(name: str, run: Callable[[pd.Series], pd.Series]) -> None:
    """A user codec: a function of a pandas series of doubles, applied in Arrow batches."""
    _plugins[name] = run


def applied(value: Column, kind: str, operation: Operation) -> Column:
    """The column after a round trip through the codec. Codecs leave types that they do not take as they are."""
    if operation.codec in _plugins:
        return F.pandas_udf(_plugins[operation.codec], "double")(value)
    if operation.codec in LOSSLESS or kind not in _REAL and operation.codec in LOSSY:
        return value
    if operation.codec in LOSSY:
        relative = operation.parameters.get("mode", "").upper() == "REL" or "rate" in operation.parameters or "precision" in operation.parameters
        return quantize(value.cast("double"), operation.error(), F.abs(value) if relative else None).cast(kind)
    raise CodecError(f"{operation.codec} is out of scope" if operation.codec in OUT_OF_SCOPE else f"no such codec: {operation.codec}")


def reduce_columns(frame: DataFrame, operations: dict[str, Iterable[Operation]]) -> DataFrame:
    """The frame with each variable's operations applied in turn."""
    out = frame
    for name, chain in operations.items():
        for operation in chain:
            out = out.withColumn(name, applied(F.col(name), out.schema[name].dataType.simpleString(), operation))
    return out


def parquet_codec(operations: dict[str, Iterable[Operation]]) -> str:
    """The compression of the store: that of the first lossless operation, else zstd."""
    return next((LOSSLESS[o.codec] for chain in operations.values() for o in chain if o.codec in LOSSLESS), "zstd")


def provided_error(before: DataFrame, after: DataFrame, keys: list[str], groups: list[str], value: str = "value") -> DataFrame:
    """What accuracy a reader gets: the largest and the root mean square error of each group."""
    both = before.select(*keys, F.col(value).alias("a")).join(after.select(*keys, F.col(value).alias("b")), keys)
    off = F.col("a") - F.col("b")
    return both.groupBy(*groups).agg(F.max(F.abs(off)).alias("max_error"), F.sqrt(F.avg(off * off)).alias("rms_error"))
