"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only: they can be changed on a session somebody else started.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One voyage, vessel or document may own a third of the rows: AQE splits such join
    # partitions, and may add an exchange to be able to do so.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The files that a stream picked up are listed one by one: by default in one task for each, up to 10,000.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Scans and streams that run within read up to 2,000 small files in a task, by default 32."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 16))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def local_session(cores: str | int = "*", app: str = "ensspark", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, for results that later steps read again.

    It lies below ``spark.checkpoint.dir``, or below the warehouse where that is unset. Whoever sets the location
    also cleans it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/ensspark/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results several later steps read: it is computed once, and a lost executor costs no rerun.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
