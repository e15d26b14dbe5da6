"""Tables laid out by ranges of ids: versions, untouched files, compaction of the change log."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from ensspark.operators import changes as ops
from ensspark.operators.numbering import next_ids
from ensspark.sources import range_tables
from ensspark.streaming import entry_changes

D = dt.date(2025, 1, 1)
CHANGE = "seq long, entry_id long, kind string, is_declared boolean, port string, arrival_date date, uploaded_files string"


@pytest.fixture
def entries(spark):
    rows = [(i, i % 7, f"P{i}", D, False, None) for i in range(1, 101)]
    return spark.createDataFrame(rows, "id long, voyage_id long, port string, arrival_date date, is_declared boolean, uploaded_files string")


def hashes(path, folders):
    found = {}
    for folder in folders:
        for name in os.listdir(f"{path}/{folder}"):
            with open(f"{path}/{folder}/{name}", "rb") as file:
                found[f"{folder}/{name}"] = hashlib.sha256(file.read()).hexdigest()
    return found


def opened(df):
    return {f.split("/data/")[1].split("/")[1] for f in df.inputFiles()}


def test_only_touched_ranges_are_written(spark, entries, tmp_path):
    path = str(tmp_path / "t")
    first = range_tables.create(entries, path, ranges=10)
    assert 10 <= len(first.folders) <= 11
    status = spark.createDataFrame([(1, 12, True), (2, 13, True), (3, 95, True), (4, 5000, True)], "seq long, entry_id long, is_declared boolean")
    keys = status.select(F.col("entry_id").alias("id"))
    touched = {12 // first.width, 13 // first.width, 95 // first.width}
    kept = [f for r, own in first.folders.items() if r not in touched for f in own]
    before = hashes(path, kept)
    second = range_tables.rewrite(spark, path, keys, lambda old: ops.set_status(old, status))
    assert hashes(path, kept) == before and {r: f for r, f in second.folders.items() if r not in touched} == {
        r: f for r, f in first.folders.items() if r not in touched
    }
    assert all(second.folders[r] != first.folders[r] for r in touched)
    now = range_tables.read(spark, path)
    assert sorted(r.id for r in now.filter("is_declared").collect()) == [12, 13, 95] and now.count() == 100
    assert range_tables.read(spark, path, 0).filter("is_declared").count() == 0  # the older version is still there
    assert opened(range_tables.read(spark, path, ranges=[12 // first.width])) == {f"_range={12 // first.width}"}
    gone = spark.createDataFrame([(r.id,) for r in now.collect() if r.id // first.width == 3], "entry_id long")
    third = range_tables.rewrite(spark, path, gone.select(F.col("entry_id").alias("id")), lambda old: ops.delete_entries(old, gone))
    assert 3 not in third.folders and range_tables.read(spark, path).count() == 100 - gone.count()
    assert range_tables.rewrite(spark, path, keys.limit(0), lambda old: old).folders == third.folders


def test_sparse_negative_and_missing_keys(spark, tmp_path):
    exact = spark.createDataFrame([(2**62 + 1,), (-(2**63),), (2**63 - 1,), (-1,), (0,), (None,)], "id long")
    for width in (1, 7, 2**40):
        assert [r.n for r in exact.select(range_tables.range_of("id", width).alias("n")).collect()] == [x and x // width for x in (2**62 + 1, -(2**63), 2**63 - 1, -1, 0, None)]
    rows = spark.createDataFrame([(-(2**40), "a"), (-1, "b"), (0, "c"), (2**40, "d")], "id long, v string")
    range_tables.create(rows, str(tmp_path / "t"), ranges=4)
    assert sorted(map(tuple, range_tables.read(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, rows.collect()))
    range_tables.append(rows.withColumn("id", F.col("id") + 5), str(tmp_path / "t"))
    assert range_tables.read(spark, str(tmp_path / "t")).count() == 8
    with pytest.raises(ValueError, match="without id"):
        range_tables.create(spark.createDataFrame([(None,)], "id long"), str(tmp_path / "u"))
    range_tables.create(rows.limit(0), str(tmp_path / "v"))
    assert range_tables.read(spark, str(tmp_path / "v")).collect() == [] and range_tables.read(spark, str(tmp_path / "v")).columns == ["id", "v"]
    with pytest.raises(FileNotFoundError):
        range_tables.read(spark, str(tmp_path / "none"))


def test_two_writers_do_not_overwrite_each_other(spark, entries, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    range_tables.create(entries, path)
    write = range_tables._write
    with monkeypatch.context() as m:

        def slow(rows, *args):
            m.setattr(range_tables, "_write", write)
            range_tables.append(entries.limit(1), path)  # somebody else, meanwhile
            return write(rows, *args)

        m.setattr(range_tables, "_write", slow)
        with pytest.raises(RuntimeError, match="another writer"):
            range_tables.append(entries.limit(2), path)
    assert range_tables.latest(path) == 1 and range_tables.read(spark, path).count() == 101


def log(spark, path, batch, rows):
    entry_changes.fold(spark.createDataFrame(rows, CHANGE)).write.parquet(f"{path}/batch_id={batch}")


def test_delete_compact_insert_read(spark, entries, tmp_path):
    store, changes = str(tmp_path / "store"), str(tmp_path / "log")
    entry_changes.create_store(entries, store, ranges=10)
    assert entry_changes.read_store(spark, store, changes).count() == 100  # no log yet
    log(spark, changes, 0, [(5, 100, "delete", None, None, None, None), (6, 7, "status", True, None, None, None), (9, 8, "edit", None, "X", D, "a")])
    log(spark, changes, 1, [(2, 8, "edit", None, "late", D, None), (3, 7, "status", False, None, None, None)])
    live = {r.id: r for r in entry_changes.read_store(spark, store, changes).collect()}
    folded = entry_changes.compact(spark, store, changes)
    assert folded.notes == {"folded": 1, "last_id": 100} and entry_changes.compact(spark, store, changes).number == folded.number
    assert {r.id: r for r in entry_changes.read_store(spark, store, changes).collect()} == live
    assert 100 not in live and live[7].is_declared and (live[8].port, live[8].uploaded_files) == ("X", "a")
    # changes that were made before what is folded already, and newer ones
    log(spark, changes, 2, [(4, 8, "edit", None, "later", D, "b"), (7, 7, "status", False, None, None, None), (1, 100, "edit", None, "gone", D, None)])
    live = {r.id: r for r in entry_changes.read_store(spark, store, changes).collect()}
    assert (live[8].port, live[8].uploaded_files) == ("X", "a") and not live[7].is_declared and 100 not in live
    entry_changes.compact(spark, store, changes)
    held = range_tables.version(store)
    new = next_ids(spark.createDataFrame([(3, "N")], "seq long, port string"), entries.limit(0), "seq", held.notes["last_id"])
    entry_changes.insert_into_store(
        new.select("id", F.lit(1).cast("long").alias("voyage_id"), "port", F.lit(D).alias("arrival_date"), F.lit(False).alias("is_declared"), F.lit("").alias("uploaded_files")),
        store,
    )
    rows = {r.id: r for r in entry_changes.read_store(spark, store, changes).collect()}
    assert sorted(rows) == [*range(1, 100), 101] and rows[101].port == "N" and rows[8] == live[8]
    assert range_tables.version(store).notes == {"folded": 2, "last_id": 101}
