"""Step streams as Structured Streaming: a store's step folders arrive as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _few_listers(spark: SparkSession) -> SparkSession:
    """A session with all of ``spark``'s settings in which tasks that list folders take many each.

    Spark takes a task a folder, up to 10,000, three times a stream and more: a
    folder a step, starting them costs far more than listing.
    """
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set(_LISTERS, str(min(int(session.conf.get(_LISTERS)), max(64, 2 * spark.sparkContext.defaultParallelism))))
    return session


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1, bytes_per_batch: int | None = None) -> DataFrame:
    """New files of a Parquet store as they appear; the limit is the back-pressure of a queue.

    A batch has a cost of its own whatever it holds, and a store has a file or more
    a step: with a limit in bytes, which takes the place of that in files, small
    steps share a batch, and the number of batches follows the data, not the steps.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    return _few_listers(spark).readStream.schema(schema).option(*limit).parquet(path)


def for_each_step(source: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, poll_seconds: float | None = None) -> StreamingQuery:
    """Calls ``run(step_frame, batch)`` for each micro-batch: all there is and stop, or polling on."""
    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if poll_seconds is None else writer.trigger(processingTime=f"{poll_seconds} seconds")).start()


def windowed(source: DataFrame, time: str, keys: list[str], width: str, late: str, value: str) -> DataFrame:
    """Event-time sums of ``value`` in tumbling windows with a watermark."""
    return source.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
