"""Tables laid out by ranges of an integer key, with versions: a change writes the ranges it touches and no others.

A version is a small file that lists the folders of each range. A change writes new folders for the ranges it touches and
then the next version, so a reader sees all of a change or nothing of it, and older versions stay readable. The ranges
are as many as the caller says when the table is made (a few more as ids grow), so neither the list nor what is collected
to find the touched ranges grows with the rows. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensspark.document_files import filesystem, put

RANGES = 256


@dataclass
class Version:
    """What a version holds: folders by range, and what the writer wants remembered with it."""

    number: int
    key: str
    width: int
    schema: str
    folders: dict[int, list[str]]
    notes: dict = field(default_factory=dict)


def range_of(key: str, width: int) -> Column:
    """Number of the range of an id, negative ones included; exact for every 64-bit integer."""
    quotient, rest = F.expr(f"CAST(`{key}` AS BIGINT) div {width}L"), F.col(key) % F.lit(width)
    return F.when(rest < 0, quotient - 1).otherwise(quotient)


def latest(path: str) -> int | None:
    """Number of the newest version, null where there is no table."""
    from pyarrow import fs

    system, base = filesystem(f"{path}/versions")
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return max((int(f.base_name) for f in found if f.base_name.isdigit()), default=None)


def version(path: str, number: int | None = None) -> Version:
    number = latest(path) if number is None else number
    if number is None:
        raise FileNotFoundError(f"no table at {path}")
    system, base = filesystem(f"{path}/versions")
    with system.open_input_stream(f"{base}/{number}", compression=None) as source:
        held = json.loads(source.read())
    return Version(**held | {"folders": {int(k): v for k, v in held["folders"].items()}})


def _publish(path: str, new: Version) -> Version:
    system, base = filesystem(f"{path}/versions")
    system.create_dir(base, recursive=True)
    if latest(path) not in (None, new.number - 1):
        raise RuntimeError(f"{path}: another writer has made version {latest(path)}")
    put(system, f"{base}/{new.number}", json.dumps(vars(new)).encode())
    return new


def _write(rows: DataFrame, path: str, key: str, width: int) -> dict[int, list[str]]:
    """Write rows into new folders, sorted by key; the folder of each range that has rows."""
    from pyarrow import fs

    target = f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn("_range", range_of(key, width))
    # dealt by sampled ranges of the key: a range with a third of the rows becomes several files
    placed.repartitionByRange("_range", key).sortWithinPartitions("_range", key).write.partitionBy("_range").parquet(f"{path}/{target}")
    system, base = filesystem(f"{path}/{target}")
    found = [f.base_name for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory]
    return {int(n.partition("=")[2]): [f"{target}/{n}"] for n in found if n.startswith("_range=")}


def create(rows: DataFrame, path: str, key: str = "id", ranges: int = RANGES, notes: dict | None = None) -> Version:
    """Lay a table out by about so many ranges of its key. Rows without a key are refused."""
    low, high, missing = rows.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
    if missing:
        raise ValueError(f"{missing} rows without {key}")
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).json()
    return _publish(path, Version(0, key, width, schema, _write(rows, path, key, width), notes or {}))


def read(spark: SparkSession, path: str, number: int | None = None, ranges: list[int] | None = None) -> DataFrame:
    """Rows of a version, of some of its ranges if they are named: no other range's files are listed or opened."""
    held = version(path, number)
    folders = [f"{path}/{f}" for r, own in sorted(held.folders.items()) if ranges is None or r in ranges for f in own]
    schema = T.StructType.fromJson(json.loads(held.schema))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str, notes: dict | None = None) -> Version:
    """The next version, with new rows beside the old ones."""
    held = version(path)
    new = _write(rows, path, held.key, held.width)
    folders = {r: held.folders.get(r, []) + new.get(r, []) for r in {*held.folders, *new}}
    return _publish(path, Version(held.number + 1, held.key, held.width, held.schema, folders, held.notes | (notes or {})))


def rewrite(
    spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], notes: dict | None = None
) -> Version:
    """The next version: ``change`` applied to the ranges that hold any of ``keys``; all other folders stay as they are.

    ``keys`` has the table's key column. ``change`` keeps the columns and leaves keys in their range.
    """
    held = version(path)
    asked = keys.select(range_of(held.key, held.width).alias("_range")).filter("_range IS NOT NULL").distinct()
    touched = sorted({r["_range"] for r in asked.collect()} & {*held.folders})  # at most one row per range
    folders = {r: own for r, own in held.folders.items() if r not in touched}
    if touched:
        old = read(spark, path, held.number, touched)
        folders |= _write(change(old).select(*old.columns), path, held.key, held.width)
    return _publish(path, Version(held.number + 1, held.key, held.width, held.schema, folders, held.notes | (notes or {})))
