import datetime as dt

import pytest
from pyspark.sql import functions as F

from ensspark import schemas
from ensspark.operators import tracker
from ensspark.sources import tables

TODAY = dt.date(2026, 1, 10)


def day(n):
    return TODAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def store(spark):
    vessels = [(1, "Alpha Star", "1016563"), (2, "Beta", None)]
    voyages = [
        (1, 1, "V1", "West Coast UK"),
        (2, 2, "V1", None),
        (3, 9, "LOST", "Adriatic"),
        (4, 2, "EMPTY", "Adriatic"),
    ]
    entries = [
        (1, 1, "GBLIV", day(-1), False, None),
        (2, 1, "IEDUB", day(0), False, ""),
        (3, 1, "GBLIV", day(2), False, "CYLMS, ITSAL ,,"),
        (4, 1, "BEANR", day(3), False, "X"),
        (5, 2, "ITSAL", day(5), False, None),
        (6, 2, "ITSAL", day(6), False, None),
        (7, 2, "ITSAL", day(7), True, None),
        (8, 2, "ITSAL", day(8), False, None),
        (9, 3, "ITSAL", day(1), False, None),
        (10, 77, "ITSAL", day(1), False, None),
    ]
    return (
        spark.createDataFrame(vessels, schemas.VESSELS),
        spark.createDataFrame(voyages, schemas.VOYAGES),
        spark.createDataFrame(entries, schemas.ENTRIES),
    )


def ids(df, column="entry_id"):
    return [r[column] for r in df.collect()]


def test_smoke_flow_of_an_empty_store(spark):
    vessels, voyages, entries = tables.empty_tables(spark)
    assert tracker.voyage_details(vessels, voyages, entries).count() == 0
    row = tracker.dashboard(vessels, voyages, entries, TODAY).first()
    assert (row.active_voyages, row.upcoming_arrivals) == (0, 0)


def test_details_hide_orphans_and_sort_by_date(store):
    rows = tracker.latest_first(tracker.voyage_details(*store))
    assert ids(rows) == [8, 7, 6, 5, 4, 3, 2, 1]


@pytest.mark.parametrize(
    "days, declared, expected",
    [
        (1, False, "urgent"),
        (0, False, "urgent"),
        (4, False, "warning"),
        (6, False, "completed"),
        (1, True, "completed"),
        (-1, False, "urgent"),
        (2, False, "urgent"),
        (3, False, "warning"),
        (5, False, "warning"),
    ],
)
def test_alert_class(spark, days, declared, expected):
    row = spark.createDataFrame([(day(days), declared)], "arrival_date date, is_declared boolean")
    assert tracker.with_alerts(row, TODAY).first().alert == expected


def test_filters(store):
    details = tracker.voyage_details(*store)
    assert sorted(ids(tracker.search(details, "STAR"))) == [1, 2, 3, 4]
    assert sorted(ids(tracker.search(details, "v1"))) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert ids(tracker.search(details, ".1")) == []
    assert len(ids(tracker.search(details, ".1", regex=True))) == 8
    assert tracker.search(details, "") is details
    assert tracker.at_port(details, "All") is details
    assert sorted(ids(tracker.at_port(details, "GBLIV"))) == [1, 3]
    assert sorted(ids(tracker.on_service(details, "West Coast UK"))) == [1, 2, 3, 4]
    assert 1 not in ids(tracker.hide_past(details, TODAY))
    assert 1 in ids(tracker.hide_past(details, TODAY, show_past=True))


def test_upcoming_includes_both_ends_and_declared(store):
    rows = tracker.soonest_first(tracker.upcoming(*store, TODAY, 7))
    assert ids(rows) == [2, 3, 4, 5, 6, 7]


def test_dashboard_counts_numbers_once(store):
    row = tracker.dashboard(*store, TODAY).first()
    assert (row.active_voyages, row.upcoming_arrivals) == (1, 6)


def test_export_columns(store):
    rows = tracker.export_rows(tracker.voyage_details(*store))
    assert rows.columns == ["Vessel", "Voyage", "Service", "Port", "Arrival Date", "Declared", "Files"]
    assert {r.Declared for r in rows.collect()} == {"Yes", "No"}


def test_checklist(store):
    rows = tracker.checklist(tracker.voyage_details(*store)).filter("entry_id = 3").collect()
    assert len(rows) == 8 and {r.code for r in rows if r.ticked} == {"CYLMS", "ITSAL"}
    ticks = tracker.checklist(tracker.voyage_details(*store)).filter("entry_id = 2")
    assert ticks.count() == 9 and ticks.filter("ticked").count() == 0


def test_lookups_and_single_rows(store, spark):
    vessels, voyages, entries = store
    assert tracker.find_vessel(vessels, "Beta").first().id == 2
    assert tracker.find_vessel(vessels, "beta").count() == 0
    assert tracker.find_entry(entries, 4).first().port == "BEANR"
    asked = spark.createDataFrame([("Alpha Star",), ("Beta",), ("None",)], "vessel_name string")
    found = {r.vessel_name: r.imo for r in tracker.imo_lookup(asked, vessels).collect()}
    assert found == {"Alpha Star": "1016563", "Beta": "", "None": ""}
    assert ids(tracker.voyage_entries(entries, 2)) == [5, 6, 7, 8]


def test_schema_evolution_and_violations(store, spark, tmp_path):
    vessels, voyages, entries = store
    entries.drop("uploaded_files", "is_declared").write.parquet(str(tmp_path / "old"))
    old = tables.read_entries(spark, str(tmp_path / "old"))
    assert old.columns == entries.columns
    assert old.filter("uploaded_files IS NULL AND NOT is_declared").count() == 10
    twice = vessels.unionByName(spark.createDataFrame([(5, "Beta", None)], schemas.VESSELS))
    broken = voyages.withColumn("voyage_number", F.when(F.col("id") != 4, F.col("voyage_number")))
    found = {tuple(r) for r in tables.violations(twice, broken, entries).collect()}
    assert found == {
        ("vessels", 2, "name is not unique"),
        ("voyages", 4, "voyage_number is null"),
        ("voyages", 3, "vessel_id has no parent"),
        ("entries", 10, "voyage_id has no parent"),
    }
