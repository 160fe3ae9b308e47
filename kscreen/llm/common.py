"""Shared working folder, written tables and small column helpers.

Intermediate tables are written below ``spark.checkpoint.dir``, the one folder that driver
and executors share, so that a lost executor costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one of our own if all runs on
    this machine, as in tests, else an error: executors would not see each other's files."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kscreen-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths that ``fresh`` has given out and ``remove`` has not deleted.
_MADE: list[str] = []


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/kscreen/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def discard(spark: SparkSession, *keep: str) -> None:
    """Delete all working tables and files made so far but those to keep: for callers who have written
    their results elsewhere. Tables that were returned by operators cannot be read after it."""
    remove(spark, *[p for p in _MADE if p not in keep])


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete working tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _MADE:
            _MADE.remove(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts lineage, fixes the rows."""
    return read_back(df, store(df, tag))


def store(df: DataFrame, tag: str) -> str:
    """Write df to a new shared path and return the path."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return path


def read_back(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker (one row at least).
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on its session cuts Arrow batches by bytes, so that long texts do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def returned() -> None:
    """Give memory that a task has freed back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back at its end what it has freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            returned()

    return wrapped


def by_place(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names that differ by case only cannot be told apart by the engine."""
    return bounded(df).toDF(*[f"c{i}" for i in range(len(df.columns))])


def taken(df: DataFrame, **names: str) -> DataFrame:
    """Columns of df under new names (new=old): the first of exactly that name, by place, whatever
    other columns differ from it by case only."""
    return by_place(df).select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until it differs from all of df's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """Two longs that stand for a row: rows with equal keys have equal id and text."""
    return [F.coalesce(id_col.cast("long"), F.lit(0)).alias("k1"), F.xxhash64(id_col.cast("long"), text_col).alias("k2")]


#: Bytes of texts that a Python worker turns into objects at once (one text at least).
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, text_col: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have at most ``most`` bytes, or one row: Spark cuts
    batches by rows, so that a batch of long texts may be large."""
    texts = batch.column(text_col)
    if not batch.num_rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + batch.num_rows + 1].astype(np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
