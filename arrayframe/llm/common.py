"""Shared folder, checkpoints and table readers used by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Cuts the lineage: lost executors cost a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def keep(path: str) -> None:
    """Notes a path of the shared folder that ``release`` is to delete."""
    _kept.append(path)


def release(spark: SparkSession) -> None:
    """Deletes what the operators have stored so far; results that still read it must have been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _kept:
        path = hadoop.Path(_kept.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(col, modulus: int):
    """crc32 of the decimal text of ``col``, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, or the first longer form of it that none of ``columns`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a sieve's segment, keys that one takes, and segments at the most (32 MB).
_BITS, _KEYS, SEGMENTS = 4096, 256, 1 << 16


def sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A Bloom filter of ``keys``, whose ``key`` is a 64-bit hash: rows (segment, words), and how many segments there are.

    Two bits a key in a segment, so that rows in it reach a task by a broadcast of
    2 bytes a key. About 1.5 % of other keys pass as well, and more where there
    are more than 16.8 million keys; no key is lost, and an exact join follows.
    """
    segments = max(1, min(SEGMENTS, -(-keys.count() // _KEYS)))
    places = keys.select(_segment(F.col(key), segments).alias("segment"), F.explode(F.array(*_places(F.col(key)))).alias("bit"))
    words = places.groupBy("segment", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    found = words.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(_BITS // 64 - 1)), lambda i: F.coalesce(F.col("found")[i], F.lit(0).cast("long")))
    return found.select("segment", dense.alias("words")), segments


def _segment(key: Column, segments: int) -> Column:
    return (F.shiftrightunsigned(key, 24) % segments).cast("int")


def _places(key: Column) -> list[Column]:
    return [F.shiftrightunsigned(key, k).bitwiseAND(F.lit(_BITS - 1)).cast("int") for k in (0, 12)]


def sifted(rows: DataFrame, key: str, by: tuple[DataFrame, int], out: bool = False) -> DataFrame:
    """``rows`` whose ``key`` may be in the sieve ``by``; with ``out`` the others, which are surely not. No row moves."""
    segments, n = by
    at, words = (unused(rows.columns, name) for name in ("segment", "words"))
    near = F.broadcast(segments.select(F.col("segment").alias(at), F.col("words").alias(words)))
    column = F.col(f"`{key}`")
    bit = lambda p: F.call_function("getbit", F.get(F.col(words), F.shiftright(p, 6)), p.bitwiseAND(F.lit(63)))
    first, second = (F.coalesce(bit(p) == 1, F.lit(False)) for p in _places(column))
    held = first & second
    return rows.withColumn(at, _segment(column, n)).join(near, at, "left").where(~held if out else held).select(*(F.col(f"`{c}`") for c in rows.columns))


def in_batches(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package sent to the executors first.

    The session's limits hold for the batches: by default 10,000 rows and 64 MiB.
    ``keeps``: a worker keeps what memory it has freed, which spares CPU where no
    other stages' workers wait beside it.
    """
    _ship(df.sparkSession)
    return df.mapInArrow(run if keeps else lean(run), schema)


def lean(run):
    """``run``, after which its worker gives back the memory of the task: it stays for later tasks, and beside it others that wait."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        returning()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trimmed()

    return task


#: glibc's names of two of its limits, and bytes from which an array's memory goes back to the system when it is freed.
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _LARGE = -1, -3, 1 << 22


def returning() -> None:
    """Lets this process give freed memory back at once if it is large; elsewhere than with glibc nothing changes."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, _LARGE)
        libc.mallopt(_M_TRIM_THRESHOLD, 2 * _LARGE)
    except (AttributeError, OSError, TypeError):
        pass


def trimmed() -> None:
    """Gives back what this process has freed, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


#: Rows and bytes (about) of a piece of a batch.
PIECE_ROWS, PIECE_BYTES = 2000, 1 << 22


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in smaller ones: results as wide as the texts are then held by the piece, here and in the JVM."""
    for batch in batches:
        rows = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors once an application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="arrayframe-")) / "arrayframe_source.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
