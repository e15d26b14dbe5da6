import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ensspark import schemas
from ensspark.operators import changes, numbering

D = dt.date


@pytest.fixture(scope="module")
def store(spark):
    return (
        spark.createDataFrame([(1, "Alpha", "1"), (4, "Beta", "2")], schemas.VESSELS),
        spark.createDataFrame([(1, 1, "V1", "S"), (2, 1, "V2", None), (3, 4, "V3", "S")], schemas.VOYAGES),
        spark.createDataFrame(
            [
                (1, 1, "GBLIV", D(2026, 1, 5), True, "CYLMS"),
                (2, 1, "IEDUB", D(2026, 1, 3), False, ""),
                (3, 2, "BEANR", D(2026, 2, 1), False, None),
            ],
            schemas.ENTRIES,
        ),
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_numbering_with_a_hot_key_spans_ranges(spark):
    hot = spark.range(0, 5000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 5000).alias("pos"))
    cold = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("b", None), (None, 1)], "k string, pos bigint")
    df = hot.unionByName(cold)
    out = numbering.number_rows(df, "n", ["k"], "pos", bits=4)
    assert out.count() == 5003
    assert out.filter("k = 'hot' AND n <> pos + 1").count() == 0
    assert rows(out.filter("k <> 'hot'"), "k", "pos", "n") == [("a", 1, 1), ("a", 3, 2), ("b", 9, 1)]


def tasks(df):
    """Rows per task of the finished rows, largest first."""
    return sorted((r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()), reverse=True)


def test_a_hot_document_with_positions_far_apart_is_spread(spark):
    far = F.when(F.col("id") % 2 == 0, F.col("id") * F.lit(2**40)).otherwise(-F.col("id") * F.lit(2**40))
    df = spark.range(0, 6000).select(F.lit("doc").alias("doc"), far.alias("pos"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.number_rows(df, "n", ["doc"], "pos")
        assert tasks(out)[0] < 2000
        assert [r.n for r in out.orderBy("pos").collect()] == list(range(1, 6001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_follow_sparse_integers_and_no_window_sees_them_all(spark):
    rng = random.Random(5)
    seqs = sorted({rng.randrange(-(2**63), 2**63) for _ in range(4000)} | {-(2**63), 2**63 - 1})
    df = spark.createDataFrame([(x,) for x in rng.sample(seqs, len(seqs))], "seq long")
    stored = spark.createDataFrame([(7,), (41,)], "id long")
    out = numbering.next_ids(df, stored, "seq")
    assert [(r.seq, r.id) for r in out.orderBy("seq").collect()] == [(x, 42 + i) for i, x in enumerate(seqs)]
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and all("_rows" in x and "[_part" in x for x in windows)  # one count per partition, no rows


def test_numbering_runs_on_across_groups_and_ranges(spark):
    big = spark.range(0, 300).select(F.lit(70000).cast("long").alias("seq"), F.col("id").alias("pos"))
    small = spark.createDataFrame([(1, 5), (1, 900), (70001, 2), (None, 3)], "seq long, pos long")
    df = big.unionByName(small)
    out = numbering.number_all(df, "n", ["seq", "pos"])
    got = [(r.seq, r.pos) for r in out.orderBy("n").collect()]
    assert got == [(None, 3), *sorted((r.seq, r.pos) for r in df.filter("seq IS NOT NULL").collect())]
    assert sorted(r.n for r in out.collect()) == list(range(1, 305))
    assert numbering.number_all(df.limit(0), "n", ["seq", "pos"]).collect() == []


def test_insert_vessels_rejects_repeats(spark, store):
    new = spark.createDataFrame(
        [(1, "Beta", "x"), (2, "Gamma", "3"), (3, "gamma", "4"), (4, "Gamma", "5")], "seq long, name string, imo_number string"
    )
    added, rejected = changes.insert_vessels(store[0], new)
    assert rows(added, "id", "name", "imo_number") == [(5, "Gamma", "3"), (6, "gamma", "4")]
    assert rows(rejected, "seq") == [(1,), (4,)]
    kept, _ = changes.insert_vessels(store[0], new, last_id=10)
    assert rows(kept, "id") == [(11,), (12,)]


def test_delete_vessels_leaves_voyages(spark, store):
    kept, result = changes.delete_vessels(store[0], spark.createDataFrame([("Beta",), ("Nope",)], "name string"))
    assert rows(kept, "name") == [("Alpha",)]
    assert rows(result, "name", "found") == [("Beta", True), ("Nope", False)]


def test_update_voyages_keeps_service_when_empty(spark, store):
    edit = spark.createDataFrame(
        [(1, 1, "N1", ""), (2, 2, "N2", "T"), (3, 2, "N3", None)],
        "seq long, voyage_id long, voyage_number string, service_name string",
    )
    out = changes.update_voyages(store[1], edit)
    assert rows(out, "id", "voyage_number", "service_name") == [(1, "N1", "S"), (2, "N3", "T"), (3, "V3", "S")]


def test_edit_entries_null_keeps_and_empty_clears(spark, store):
    edit = spark.createDataFrame(
        [(1, 1, "AAA", D(2026, 5, 1), None), (2, 2, "BBB", D(2026, 5, 2), "X"), (3, 2, "CCC", D(2026, 5, 3), "")],
        "seq long, entry_id long, port string, arrival_date date, uploaded_files string",
    )
    out = {r.id: r for r in changes.edit_entries(store[2], edit).collect()}
    assert (out[1].port, out[1].uploaded_files) == ("AAA", "CYLMS")
    assert (out[2].port, out[2].uploaded_files) == ("CCC", "")
    assert (out[3].port, out[3].uploaded_files) == ("BEANR", None)


def test_status_and_delete(spark, store):
    status = spark.createDataFrame([(1, 2, True), (2, 1, True), (3, 1, False)], "seq long, entry_id long, is_declared boolean")
    assert rows(changes.set_status(store[2], status), "id", "is_declared") == [(1, False), (2, True), (3, False)]
    gone = spark.createDataFrame([(1,), (3,), (3,)], "entry_id long")
    assert rows(changes.delete_entries(store[2], gone), "id") == [(2,)]


def test_clone(spark, store):
    asked = spark.createDataFrame(
        [(1, 1, "C1", "2026-03-01"), (2, 9, "C2", "2026-03-01"), (3, 3, "C3", "2026-03-01"), (4, 2, "C4", "1.3.2026")],
        "seq long, voyage_id long, voyage_number string, start string",
    )
    checked = changes.check_clones(store[1], store[2], asked)
    voyages, entries, result = changes.clone_voyages(store[1], store[2], checked)
    assert rows(voyages, "id", "vessel_id", "voyage_number", "service_name") == [(4, 1, "C1", "S")]
    assert rows(entries, "id", "voyage_id", "port", "arrival_date", "is_declared") == [
        (4, 4, "IEDUB", D(2026, 3, 1), False),
        (5, 4, "GBLIV", D(2026, 3, 3), False),
    ]
    assert entries.filter("uploaded_files IS NOT NULL").count() == 0
    assert [r.message for r in result.orderBy("seq").collect()] == [
        "Voyage cloned successfully.",
        "Original voyage not found.",
        "Original voyage has no entries to clone.",
        "Invalid date format.",
    ]


def test_submissions(spark, store):
    asked = spark.createDataFrame(
        [(1, "Alpha", "N1", "S"), (2, "", "N2", "S"), (3, "Alpha", "N3", "S"), (4, "Alpha", "N4", "S")],
        "seq long, vessel_name string, voyage_number string, service_name string",
    )
    calls = spark.createDataFrame(
        [
            (1, 1, "GBLIV", "2026-01-09"),
            (1, 2, "", "2026-01-10"),
            (1, 3, "IEDUB", "2026-01-11"),
            (2, 1, "GBLIV", "2026-01-09"),
            (3, 1, "GBLIV", "tomorrow"),
        ],
        "seq long, pos long, port string, arrival string",
    )
    checked = changes.check_submissions(asked, calls, store[0])
    assert {r.seq: r.reasons for r in checked.collect()} == {
        1: [], 2: ["vessel required"], 3: ["invalid date"], 4: ["no port call"],
    }
    web = changes.check_submissions(asked, calls, store[0], web=True, as_of=D(2026, 1, 10), max_calls=2)
    assert {r.seq: r.reasons for r in web.collect()} == {
        1: ["arrival in the past", "too many port calls"],
        2: ["vessel required", "arrival in the past"],
        3: ["invalid date"],
        4: [],
    }
    voyages, entries = changes.insert_voyages(store[1], store[2], checked, calls)
    assert rows(voyages, "id", "vessel_id", "voyage_number") == [(4, 1, "N1")]
    assert rows(entries, "id", "voyage_id", "port", "uploaded_files") == [(4, 4, "GBLIV", ""), (5, 4, "IEDUB", "")]


def test_mapping(spark):
    mapping = spark.createDataFrame([("A", "1"), ("B", "2")], "port string, ref_num string")
    new = spark.createDataFrame([(1, " B ", " 3 "), (2, "C", ""), (3, "D", "4")], "seq long, port string, ref_num string")
    whole, rejected = changes.upsert_mapping(mapping, new)
    assert rows(whole, "port", "ref_num") == [("A", "1"), ("B", "3"), ("D", "4")]
    assert rows(rejected, "seq") == [(2,)]
    assert rows(changes.delete_mapping(whole, whole.filter("port = 'A'")), "port") == [("B",), ("D",)]


def test_deleted_ids_are_not_given_again(spark):
    voyages = spark.createDataFrame([(1, 1, "A", None)], "id long, vessel_id long, voyage_number string, service_name string")
    entries = spark.createDataFrame([], "id long, voyage_id long, port string, arrival_date date, is_declared boolean, uploaded_files string")
    checked = spark.createDataFrame([(1, 1, "B", None, [])], "seq long, vessel_id long, voyage_number string, service_name string, reasons array<string>")
    calls = spark.createDataFrame([(1, 1, "GBLIV", "2025-01-01")], "seq long, pos int, port string, arrival string")
    new_voyages, new_entries = changes.insert_voyages(voyages, entries, checked, calls, last_voyage=7, last_entry=9)
    assert [r.id for r in new_voyages.collect()] == [8]
    assert [(r.id, r.voyage_id) for r in new_entries.collect()] == [(10, 8)]
