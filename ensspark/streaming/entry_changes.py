"""A stream of entry changes, kept as a folded log beside the entry table.

Rewriting the whole table for every micro-batch would cost its full size each time. Instead each batch
adds one folded row per changed entry to a log; readers merge table and log. ``compact`` folds the log's batches into
the ranges of ids that they touch and makes a new version of the table, which knows the batches it holds.

Changes are rows ``(seq, entry_id, kind, is_declared, port, arrival_date, uploaded_files)`` with kind
status, edit or delete. Kinds touch different columns and ids are never reused, so folding keeps the
last value of each column and whether a delete came. The table keeps the ``seq`` of what was folded into it, so changes
that arrive late, even after a compaction, do not undo later ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ensspark.document_files import filesystem
from ensspark.sources import range_tables

FOLDED = """entry_id bigint, status_seq bigint, is_declared boolean, edit_seq bigint, port string,
  arrival_date date, files_seq bigint, uploaded_files string, deleted boolean"""


def _last(seq: str, *values: str) -> list[Column]:
    return [F.max_by(v, seq).alias(v) for v in values]


def fold(changes: DataFrame) -> DataFrame:
    """One row per entry with the last value of each column and the seq it came with."""
    seq, kind = F.col("seq"), F.col("kind")
    marked = changes.withColumns(
        {
            "status_seq": F.when(kind == "status", seq),
            "edit_seq": F.when(kind == "edit", seq),
            "files_seq": F.when((kind == "edit") & F.col("uploaded_files").isNotNull(), seq),
            "deleted": kind == "delete",
        }
    )
    return merge(marked)


def merge(folded: DataFrame) -> DataFrame:
    """Fold rows of several batches into one per entry; partial on the map side."""
    return folded.groupBy("entry_id").agg(
        F.max("status_seq").alias("status_seq"),
        *_last("status_seq", "is_declared"),
        F.max("edit_seq").alias("edit_seq"),
        *_last("edit_seq", "port", "arrival_date"),
        F.max("files_seq").alias("files_seq"),
        *_last("files_seq", "uploaded_files"),
        F.bool_or("deleted").alias("deleted"),
    )


def collect_changes(changes: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append the folded changes of each micro-batch to the log, then stop when caught up.

    A batch overwrites its own folder, so running it again is harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


SEQS = ("status_seq", "edit_seq", "files_seq")


def folded_into(entries: DataFrame, log: DataFrame) -> DataFrame:
    """The entry table with logged changes applied, and the seq of the last change of each sort.

    A change counts if it is later than the one that the table already holds.
    """
    held = entries.withColumns({c: F.lit(None).cast("long") for c in SEQS if c not in entries.columns})
    new = merge(log)
    renamed = new.withColumnsRenamed({c: f"_{c}" for c in new.columns if c != "entry_id"} | {"entry_id": "id"})

    def newer(seq: str) -> Column:
        return F.col(f"_{seq}").isNotNull() & F.coalesce(F.col(f"_{seq}") > F.col(seq), F.lit(True))

    def value(name: str, seq: str) -> Column:
        return F.when(newer(seq), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    declared = F.when(newer("status_seq"), F.coalesce("_is_declared", "is_declared")).otherwise(F.col("is_declared"))

    return (
        held.join(renamed, "id", "left")
        .filter(~F.coalesce("_deleted", F.lit(False)))
        .select(
            "id",
            "voyage_id",
            value("port", "edit_seq"),
            value("arrival_date", "edit_seq"),
            declared.alias("is_declared"),
            value("uploaded_files", "files_seq"),
            *[F.greatest(c, f"_{c}").alias(c) for c in SEQS],
        )
    )


def current(entries: DataFrame, log: DataFrame) -> DataFrame:
    """The entry table with all logged changes applied."""
    return folded_into(entries, log).drop(*SEQS)


# --- compaction -------------------------------------------------------------------------------------


def batches(log: str) -> list[int]:
    """Numbers of the log's batches."""
    from pyarrow import fs

    system, base = filesystem(log)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(f.base_name.partition("=")[2]) for f in found if f.base_name.startswith("batch_id="))


def read_log(spark: SparkSession, log: str, numbers: list[int]) -> DataFrame:
    """Folded rows of some batches; others are not opened."""
    folders = [f"{log}/batch_id={n}" for n in numbers]
    return spark.read.schema(FOLDED).parquet(*folders) if folders else spark.createDataFrame([], FOLDED)


def create_store(entries: DataFrame, path: str, ranges: int = range_tables.RANGES) -> range_tables.Version:
    """The entry table laid out by ranges of its id, with no changes folded in."""
    rows = entries.withColumns({c: F.lit(None).cast("long") for c in SEQS if c not in entries.columns})
    last = rows.agg(F.max("id")).first()[0] or 0
    return range_tables.create(rows, path, "id", ranges, {"folded": -1, "last_id": last})


def compact(spark: SparkSession, path: str, log: str) -> range_tables.Version:
    """Fold the log's new batches into the ranges they touch. Running it again, or with nothing new, changes nothing.

    Batch numbers ascend, so a version remembers the last one it holds.
    """
    held = range_tables.version(path)
    new = [n for n in batches(log) if n > held.notes["folded"]]
    if not new:
        return held
    rows = read_log(spark, log, new)
    keys = rows.select(F.col("entry_id").alias("id"))
    return range_tables.rewrite(spark, path, keys, lambda old: folded_into(old, rows), {"folded": new[-1]})


def insert_into_store(rows: DataFrame, path: str) -> range_tables.Version:
    """Add new entries; ``last_id`` follows, so that ids of deleted entries are never given again."""
    held = range_tables.version(path)
    full = rows.withColumns({c: F.lit(None).cast("long") for c in SEQS if c not in rows.columns})
    last = full.agg(F.max("id")).first()[0] or 0
    names = [f["name"] for f in json.loads(held.schema)["fields"]]
    return range_tables.append(full.select(*names), path, {"last_id": max(last, held.notes["last_id"])})


def read_store(spark: SparkSession, path: str, log: str) -> DataFrame:
    """All entries as they are now: the newest version with the batches that it does not hold yet."""
    held = range_tables.version(path)
    new = [n for n in batches(log) if n > held.notes["folded"]]
    return current(range_tables.read(spark, path, held.number), read_log(spark, log, new))
