"""What the operators share: settings, the shared work folder, landed tables, reading by path."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.session import shared_dir, tune

# Python workers receive small batches, so that a batch of long documents stays within their memory.
BATCH_ROWS = "1000"
BATCH_BYTES = "16m"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on.

    Functions travel to the executors by value, so the package need not be installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (below ``spark.checkpoint.dir``)."""
    return shared_dir(spark, name)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Chosen columns of an input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


class Smallest:
    """The n distinct texts with the smallest hashes seen so far: a sample that does not depend on the partitions."""

    def __init__(self, n: int):
        self.n, self.kept, self.edge = n, {}, 1 << 64

    def add(self, text: str) -> None:
        h = xxhash.xxh3_64_intdigest(text)
        if h < self.edge:
            self.kept[text] = h
            if len(self.kept) >= 2 * self.n:
                self.kept = dict(sorted(self.kept.items(), key=lambda x: (x[1], x[0]))[: self.n])
                self.edge = max(self.kept.values())

    def rows(self) -> list[tuple[str, int]]:
        return [(t, h >> 1) for t, h in sorted(self.kept.items(), key=lambda x: (x[1], x[0]))[: self.n]]


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after the last one the worker gives free memory back, since it stays beside later stages."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept[T](name: str, make: Callable[[], T]) -> T:
    """What a worker process keeps from task to task; modules that travel by value don't."""
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(key: str, n: int) -> F.Column:
    """Which of n parts of a hot group a row belongs to."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
