"""Tracker queries: voyage details, filters, alerts, dashboard, export, checklist."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensspark.functions.values import csv_to_list, literal_list, or_default
from ensspark.operators.skew import splittable
from ensspark.schemas import CHECKLIST_CODES, CHECKLIST_SERVICE

ALL = "All"


def voyage_details(vessels: DataFrame, voyages: DataFrame, entries: DataFrame) -> DataFrame:
    """Port calls with their voyage and vessel; rows without a partner are hidden.

    No join hint: vessels grow with the data, so the size-checked choice stays with the optimizer,
    and AQE splits voyages or vessels that own a large part of the rows.
    """
    ves = vessels.select(F.col("id").alias("vessel_id"), F.col("name").alias("vessel_name"))
    voy = voyages.select(F.col("id").alias("voyage_id"), "vessel_id", "voyage_number", "service_name")
    ent = entries.select(
        F.col("id").alias("entry_id"), "voyage_id", "port", "arrival_date", "is_declared", "uploaded_files"
    )
    return (
        ent.join(voy.join(ves, "vessel_id"), "voyage_id")
        .select(
            "voyage_id",
            "vessel_name",
            "voyage_number",
            "service_name",
            "entry_id",
            "port",
            "arrival_date",
            "is_declared",
            "uploaded_files",
        )
    )


def latest_first(details: DataFrame) -> DataFrame:
    return details.orderBy(F.desc("arrival_date"), "entry_id")


def search(details: DataFrame, term: str | None, regex: bool = False) -> DataFrame:
    """Lower-cased term in the vessel name or the voyage number; null columns don't match."""
    if not term:
        return details
    needle = term.lower()

    def hit(name: str) -> Column:
        text = F.lower(F.col(name))
        found = text.rlike(needle) if regex else text.contains(needle)
        return F.coalesce(found, F.lit(False))

    return details.filter(hit("vessel_name") | hit("voyage_number"))


def _equals(details: DataFrame, column: str, value: str | None) -> DataFrame:
    return details if not value or value == ALL else details.filter(F.col(column) == value)


def at_port(details: DataFrame, port: str | None) -> DataFrame:
    return _equals(details, "port", port)


def on_service(details: DataFrame, service: str | None) -> DataFrame:
    return _equals(details, "service_name", service)


def hide_past(details: DataFrame, as_of: dt.date, show_past: bool = False) -> DataFrame:
    return details if show_past else details.filter(F.col("arrival_date") >= F.lit(as_of))


def filtered(
    details: DataFrame,
    as_of: dt.date,
    term: str | None = None,
    port: str | None = None,
    service: str | None = None,
    show_past: bool = False,
    regex: bool = False,
) -> DataFrame:
    """All list filters together."""
    rows = search(details, term, regex)
    return hide_past(on_service(at_port(rows, port), service), as_of, show_past)


def alert_class(as_of: dt.date) -> Column:
    days = F.datediff("arrival_date", F.lit(as_of))
    return (
        F.when(F.coalesce(F.col("is_declared"), F.lit(False)), "completed")
        .when(days <= 2, "urgent")
        .when(days <= 5, "warning")
        .otherwise("completed")
    )


def with_alerts(details: DataFrame, as_of: dt.date) -> DataFrame:
    return details.withColumn("alert", alert_class(as_of))


def declared_label(yes: str, no: str) -> Column:
    return F.when(F.coalesce(F.col("is_declared"), F.lit(False)), yes).otherwise(no)


def list_rows(details: DataFrame, as_of: dt.date) -> DataFrame:
    """The columns of the on-screen list."""
    return details.select(
        "entry_id",
        "vessel_name",
        "service_name",
        "voyage_number",
        "port",
        "arrival_date",
        declared_label("YES", "NO").alias("declared"),
        alert_class(as_of).alias("alert"),
    )


def upcoming(
    vessels: DataFrame, voyages: DataFrame, entries: DataFrame, as_of: dt.date, days: int = 7
) -> DataFrame:
    """Port calls from ``as_of`` to ``days`` later, both ends included, declared ones too."""
    window = F.col("arrival_date").between(F.lit(as_of), F.date_add(F.lit(as_of), days))
    return voyage_details(vessels, voyages, entries.filter(window)).select(
        F.col("vessel_name").alias("vessel"),
        "voyage_number",
        "service_name",
        "port",
        "arrival_date",
        "entry_id",
    )


def soonest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("arrival_date", "entry_id")


def active_voyages(vessels: DataFrame, voyages: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct voyage numbers that the detail list would show.

    Semi joins on pre-aggregated keys: the port calls themselves are never multiplied or moved.
    """
    with_entry = entries.select("voyage_id").distinct()
    with_vessel = vessels.select(F.col("id").alias("vessel_id"))
    shown = (
        voyages.select(F.col("id").alias("voyage_id"), "vessel_id", "voyage_number")
        .join(with_entry, "voyage_id", "left_semi")
        .join(with_vessel, "vessel_id", "left_semi")
    )
    # Two steps instead of count(distinct): equal numbers collapse before the shuffle.
    return shown.select("voyage_number").distinct().agg(F.count("voyage_number").alias("active_voyages"))


def dashboard(
    vessels: DataFrame, voyages: DataFrame, entries: DataFrame, as_of: dt.date, days: int = 7
) -> DataFrame:
    """One row: active voyages and arrivals inside the window."""
    arrivals = upcoming(vessels, voyages, entries, as_of, days).agg(F.count(F.lit(1)).alias("n"))
    return active_voyages(vessels, voyages, entries).withColumn("upcoming_arrivals", arrivals.scalar())


def export_rows(details: DataFrame) -> DataFrame:
    """The seven export columns under their display names."""
    return details.select(
        F.col("vessel_name").alias("Vessel"),
        F.col("voyage_number").alias("Voyage"),
        F.col("service_name").alias("Service"),
        F.col("port").alias("Port"),
        F.col("arrival_date").alias("Arrival Date"),
        declared_label("Yes", "No").alias("Declared"),
        F.col("uploaded_files").alias("Files"),
    )


def voyage_entries(entries: DataFrame, voyage_id: int | None = None) -> DataFrame:
    """Port calls in order of arrival, of one voyage or of all."""
    rows = entries if voyage_id is None else entries.filter(F.col("voyage_id") == voyage_id)
    rows = rows.select("voyage_id", F.col("id").alias("entry_id"), "port", "arrival_date")
    return rows.orderBy("voyage_id", "arrival_date", "entry_id")


def first_arrivals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("voyage_id").agg(F.min("arrival_date").alias("first_arrival"))


def arrival_offsets(entries: DataFrame) -> DataFrame:
    """Days from the first arrival of the voyage to each port call."""
    return entries.join(splittable(first_arrivals(entries), "voyage_id"), "voyage_id").select(
        F.col("id").alias("entry_id"),
        "voyage_id",
        "port",
        "arrival_date",
        F.datediff("arrival_date", "first_arrival").alias("day_offset"),
    )


def find_vessel(vessels: DataFrame, name: str) -> DataFrame:
    return vessels.filter(F.col("name") == name).orderBy("id").limit(1)


def find_entry(entries: DataFrame, entry_id: int) -> DataFrame:
    return entries.filter(F.col("id") == entry_id).limit(1)


def imo_lookup(requests: DataFrame, vessels: DataFrame, name_column: str = "vessel_name") -> DataFrame:
    """IMO of each requested vessel name; empty text for an unknown name."""
    known = vessels.select(F.col("name").alias(name_column), F.col("imo_number").alias("imo"))
    return requests.join(known, name_column, "left").withColumn("imo", or_default(F.col("imo"), ""))


def checklist_codes() -> Column:
    """Codes to tick off at a port call of the service; null where no list applies."""
    codes = F.lit(None).cast("array<string>")
    on_list = F.col("service_name") == CHECKLIST_SERVICE
    for port, values in CHECKLIST_CODES.items():
        codes = F.when(on_list & (F.col("port") == port), literal_list(values)).otherwise(codes)
    return codes


def checklist(details: DataFrame) -> DataFrame:
    """One row per applicable code with the tick taken from the uploaded files."""
    return (
        details.withColumn("code", F.explode(checklist_codes()))
        .withColumn("ticked", F.array_contains(csv_to_list(F.col("uploaded_files")), F.col("code")))
        .select("entry_id", "port", "code", "ticked")
    )


def hidden_rows(vessels: DataFrame, voyages: DataFrame, entries: DataFrame) -> DataFrame:
    """Voyages and port calls the detail list does not show, with the reason."""
    ves = vessels.select(F.col("id").alias("vessel_id"))
    voy = voyages.select(F.col("id").alias("voyage_id"), "vessel_id")
    orphans = voy.join(ves, "vessel_id", "left_anti")
    ent = entries.select("id", "voyage_id")
    return (
        orphans.select(F.lit("voyage").alias("kind"), F.col("voyage_id").alias("id"), F.lit("no vessel").alias("reason"))
        .unionByName(
            voy.join(ent.select("voyage_id").distinct(), "voyage_id", "left_anti").select(
                F.lit("voyage").alias("kind"), F.col("voyage_id").alias("id"), F.lit("no entries").alias("reason")
            )
        )
        .unionByName(
            ent.join(orphans.select("voyage_id"), "voyage_id").select(
                F.lit("entry").alias("kind"), "id", F.lit("no vessel").alias("reason")
            )
        )
        .unionByName(
            ent.join(voy.select("voyage_id"), "voyage_id", "left_anti").select(
                F.lit("entry").alias("kind"), "id", F.lit("no voyage").alias("reason")
            )
        )
    )
