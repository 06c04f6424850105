"""Engines by name: detection, Parquet stores by step, plugins, null and inline."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import block_stats
from ..operators.steps import select_steps

#: Engine names that stand for the step-partitioned Parquet store here.
STORES = frozenset(["parquet", "bp", "bp3", "bp4", "bp5", "filestream", "file", "bpfile", "daos", "mhs"])
#: Names that stand for a stream of steps; the store is polled.
STREAMS = frozenset(["sst", "dataman", "ssc", "insituanalysis", "insituvisualization", "codecoupling", "dataspaces", "effis"])
REJECTED = {"hdf5": "binary HDF5 files are out of scope; write the same layout as Parquet"}
PRESETS = {
    "filestream": {"OpenTimeoutSecs": "3600"},
    "insituanalysis": {"QueueLimit": "1", "QueueFullPolicy": "Block", "RendezvousReaderCount": "1"},
    "insituvisualization": {"QueueLimit": "3", "QueueFullPolicy": "Discard", "RendezvousReaderCount": "0"},
    "codecoupling": {"QueueLimit": "1", "QueueFullPolicy": "Block", "RendezvousReaderCount": "1"},
}


#: The folder of block statistics inside a store; readers of cells pass it over.
BLOCKS = "_blocks"


class EngineError(ValueError):
    """An engine that does not exist or can not do this."""


_plugins: dict[str, tuple[Callable, Callable]] = {}


def register_engine(name: str, read: Callable[..., DataFrame], write: Callable[..., None]) -> None:
    """A plugin: ``read(spark, path, **options)`` and ``write(frame, path, **options)``."""
    _plugins[name.lower()] = (read, write)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def detect(spark: SparkSession, path: str, mode: str = "read") -> str:
    """The engine that a path asks for: by extension, else the store, which must exist to be read."""
    for ending, engine in ((".h5", "hdf5"), (".aca", "campaign"), (".ats", "timeseries")):
        if path.endswith(ending):
            return engine
    if mode == "read" and not exists(spark, path):
        raise FileNotFoundError(path)
    return "parquet"


def write(frame: DataFrame, path: str, engine: str = "parquet", mode: str = "write", order: tuple[str, ...] = (), append_after: int | None = None, stats: tuple[str, ...] = (), **options: str) -> None:
    """Writes cells by step. Rows are sorted by ``order`` within files, for row-group statistics to prune boxes.

    ``stats`` names variables whose block statistics over the dimensions
    ``order`` are kept beside the cells, so that range queries ask them alone.

    ``append_after`` keeps that many steps (negative: counted from the end) and
    replaces what follows. The new steps are written beside the store first; only
    then the dropped ones go and the new ones are moved in.
    """
    name = engine.lower()
    if name in _plugins:
        return _plugins[name][1](frame, path, **options)
    if name in REJECTED:
        raise EngineError(REJECTED[name])
    if name in ("null", "nullcore", "skeleton"):
        return frame.write.format("noop").mode("overwrite").save()
    if name == "inline":
        return frame.createOrReplaceTempView(path)
    if name not in STORES | STREAMS:
        raise EngineError(f"no such engine: {engine}")
    if append_after is not None and exists(frame.sparkSession, path):
        return _replace_after(frame, path, append_after, order, stats)
    _store(frame, path, {"write": "overwrite", "append": "append"}[mode], order, stats)


def _store(frame: DataFrame, path: str, how: str, order: tuple[str, ...], stats: tuple[str, ...]) -> None:
    # ranges of the first index within a step: few files a step, and each file's extremes cover a strip
    out = frame.repartitionByRange("step", order[0]).sortWithinPartitions("step", *order) if order else frame.hint("rebalance", "step")
    out.write.mode(how).partitionBy("step").parquet(path)
    if stats:
        parts = [block_stats(frame, order, v).withColumns({"name": F.lit(v), "min": F.col("min").cast("double"), "max": F.col("max").cast("double")}) for v in stats]
        reduce(DataFrame.unionByName, parts).write.mode(how).partitionBy("step").parquet(f"{path}/{BLOCKS}")


def add_blocks(blocks: DataFrame, path: str, name: str) -> None:
    """Keeps block statistics of a variable that has no cells of its own in the store."""
    found = blocks.withColumns({"name": F.lit(name), "min": F.col("min").cast("double"), "max": F.col("max").cast("double")})
    found.write.mode("append").partitionBy("step").parquet(f"{path}/{BLOCKS}")


def _replace_after(frame: DataFrame, path: str, append_after: int, order: tuple[str, ...], stats: tuple[str, ...]) -> None:
    spark = frame.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    _store(frame, staging, "overwrite", order, stats)
    steps = [r[0] for r in spark.read.parquet(path).select("step").distinct().orderBy("step").collect()]  # a number for each step
    keep = max(0, len(steps) + append_after + 1) if append_after < 0 else append_after
    for s in steps[keep:]:
        for base in (path, f"{path}/{BLOCKS}"):
            fs.delete(hadoop.Path(f"{base}/step={s}"), True)
    for source, target in ((f"{staging}/{BLOCKS}", f"{path}/{BLOCKS}"), (staging, path)):
        if not fs.exists(hadoop.Path(source)):
            continue
        fs.mkdirs(hadoop.Path(target))
        for status in fs.listStatus(hadoop.Path(source)):
            if not status.getPath().getName().startswith("step="):
                continue
            to = hadoop.Path(f"{target}/{status.getPath().getName()}")
            if not fs.exists(to):
                fs.rename(status.getPath(), to)
                continue
            for one in fs.listStatus(status.getPath()):  # a step that is kept gets more cells
                fs.rename(one.getPath(), hadoop.Path(to, one.getPath().getName()))
    fs.delete(hadoop.Path(staging), True)


def read_blocks(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The kept block statistics of a variable (step, block_id, start_, count_, min, max), if there are any."""
    if not exists(spark, f"{path}/{BLOCKS}"):
        return None
    kept = spark.read.option("mergeSchema", True).parquet(f"{path}/{BLOCKS}")
    found = kept.where(F.col("name") == name).drop("name").withColumn("step", F.col("step").cast("long"))
    return found if kept.where(F.col("name") == name).limit(1).count() else None


def read(spark: SparkSession, path: str, engine: str | None = None, select_step: str = "", flatten: int | None = None, **options: str) -> DataFrame:
    """The cells of a store; ``select_step`` is a step filter, ``flatten`` the blocks of a step to see all steps as one."""
    from . import campaign, timeseries

    name = (engine or detect(spark, path)).lower()
    if name in _plugins:
        frame = _plugins[name][0](spark, path, **options)
    elif name in REJECTED:
        raise EngineError(REJECTED[name])
    elif name == "inline":
        frame = spark.table(path)
    elif name in ("null", "nullcore", "skeleton"):
        frame = spark.createDataFrame([], "step bigint, block_id bigint, value double")
    elif name == "timeseries":
        frame = timeseries.read(spark, path)
    elif name == "campaign":
        frame = campaign.Campaign.open(spark, path).datasets()
    elif name in STORES | STREAMS:
        frame = spark.read.parquet(path)
        frame = frame.withColumn("step", F.col("step").cast("long")) if "step" in frame.columns else frame
    else:
        raise EngineError(f"no such engine: {engine}")
    if select_step:
        frame = select_steps(frame, select_step)
    if flatten is not None:
        from ..operators.steps import flatten_steps

        frame = flatten_steps(frame, flatten)
    return frame
