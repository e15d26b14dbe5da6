"""Table changes as ``(table, changes) -> table``; rejected changes come back as rows.

Every change row carries ``seq``, a unique integer in the order of arrival.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensspark.functions.values import blank, iso_date, strip
from ensspark.operators.numbering import last_id_of, next_ids, number_all
from ensspark.operators.tracker import checklist_codes, first_arrivals

# Messages that results carry.
DUPLICATE_VESSEL = "Vessel with this name already exists."
VESSEL_DELETED = "Vessel deleted."
NO_VESSEL = "Vessel not found."
NO_VOYAGE = "Original voyage not found."
NO_ENTRIES = "Original voyage has no entries to clone."
BAD_DATE = "Invalid date format."
CLONED = "Voyage cloned successfully."


def latest(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last change of each key; pre-aggregated, so a hot key costs nothing extra."""
    values = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_last"))
    return last.select(*keys, "_last.*")


# --- vessels ------------------------------------------------------------------------------------


def insert_vessels(
    vessels: DataFrame, new: DataFrame, last_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Insert ``(seq, name, imo_number)``; a name that exists or came earlier is rejected.

    Returns the new rows (append them with ``unionByName``) and the rejects with a message.
    """
    first = new.groupBy("name").agg(
        F.min("seq").alias("seq"), F.min_by("imo_number", "seq").alias("imo_number")
    )
    accepted = first.join(vessels.select("name"), "name", "left_anti")
    rows = next_ids(accepted, vessels, "seq", last_id).select("id", "name", "imo_number", "seq")
    rejects = new.join(accepted.select("seq"), "seq", "left_anti").withColumn("message", F.lit(DUPLICATE_VESSEL))
    return rows, rejects


def delete_vessels(vessels: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete by name without touching voyages. Also tells, per name, whether it was there."""
    wanted = names.select("name").distinct()
    kept = vessels.join(wanted, "name", "left_anti")
    known = vessels.select("name", F.lit(True).alias("found"))
    result = wanted.join(known, "name", "left").select(
        "name",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.when(F.col("found"), VESSEL_DELETED).otherwise(NO_VESSEL).alias("message"),
    )
    return kept, result


# --- voyages with their port calls --------------------------------------------------------------


def check_submissions(
    submissions: DataFrame,
    calls: DataFrame,
    vessels: DataFrame,
    web: bool = False,
    as_of: dt.date | None = None,
    max_calls: int | None = None,
) -> DataFrame:
    """Reasons why a submission cannot be saved; an empty list means it can.

    ``submissions(seq, vessel_name, voyage_number, service_name)`` and
    ``calls(seq, pos, port, arrival)`` with the date as text. The desktop form needs a port call
    with port and date and refuses bad dates; the web form skips blank ports, allows none, and
    with ``as_of`` refuses arrivals in the past.
    """
    used = ~blank(F.col("port")) if web else ~blank(F.col("port")) & ~blank(F.col("arrival"))
    day = iso_date(F.col("arrival"))
    past = day < F.lit(as_of) if as_of is not None else F.lit(False)
    per_submission = calls.groupBy("seq").agg(
        F.count_if(used).alias("_used"),
        F.count_if(used & day.isNull()).alias("_bad_date"),
        F.count_if(used & F.coalesce(past, F.lit(False))).alias("_past"),
        F.count(F.lit(1)).alias("_all"),
    )
    known = vessels.select(F.col("name").alias("vessel_name"), F.col("id").alias("vessel_id"))

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    rules = [
        F.when(blank(F.col("vessel_name")), "vessel required"),
        F.when(blank(F.col("voyage_number")), "voyage number required"),
        F.when(~blank(F.col("vessel_name")) & F.col("vessel_id").isNull(), "vessel unknown"),
        F.when(count("_bad_date") > 0, "invalid date"),
    ]
    if not web:
        rules.append(F.when(count("_used") == 0, "no port call"))
    if as_of is not None:
        rules.append(F.when(count("_past") > 0, "arrival in the past"))
    if max_calls is not None:
        rules.append(F.when(count("_all") > max_calls, "too many port calls"))
    return (
        submissions.join(per_submission, "seq", "left")
        .join(known, "vessel_name", "left")
        .withColumn("reasons", F.array_compact(F.array(*rules)))
        .drop("_used", "_bad_date", "_past", "_all")
    )


def insert_voyages(
    voyages: DataFrame,
    entries: DataFrame,
    checked: DataFrame,
    calls: DataFrame,
    web: bool = False,
    last_voyage: int | None = None,
    last_entry: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New voyage rows and new entry rows of the submissions without a reason against them.

    ``last_voyage`` and ``last_entry`` are the highest ids ever given, for stores that never reuse one.
    Both keep ``seq`` of the submission. Entries start undeclared with an empty file list.
    """
    good = checked.filter(F.size("reasons") == 0)
    new_voyages = next_ids(good, voyages, "seq", last_voyage).select(
        "id", "vessel_id", "voyage_number", "service_name", "seq"
    )
    used = ~blank(F.col("port")) if web else ~blank(F.col("port")) & ~blank(F.col("arrival"))
    owners = new_voyages.select("seq", F.col("id").alias("voyage_id"))
    rows = calls.filter(used).join(owners, "seq")
    start = last_id_of(entries, last_entry)
    numbered = number_all(rows, "_n", ["seq", "pos"])
    new_entries = numbered.select(
        (F.col("_n") + start).alias("id"),
        "voyage_id",
        "port",
        iso_date(F.col("arrival")).alias("arrival_date"),
        F.lit(False).alias("is_declared"),
        F.lit("").alias("uploaded_files"),
        "seq",
    )
    return new_voyages, new_entries


def update_voyages(voyages: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``(seq, voyage_id, voyage_number, service_name)``; an empty service keeps the old one.

    Changes are folded per voyage: the last number wins, and the last service that is not empty.
    """
    service = F.nullif("service_name", F.lit(""))
    new = changes.groupBy(F.col("voyage_id").alias("id")).agg(
        F.max_by("voyage_number", "seq").alias("_number"),
        F.max_by("service_name", F.when(service.isNotNull(), F.col("seq"))).alias("_service"),
    )
    return voyages.join(new, "id", "left").select(
        "id",
        "vessel_id",
        F.coalesce("_number", "voyage_number").alias("voyage_number"),
        F.coalesce("_service", "service_name").alias("service_name"),
    )


# --- port-call entries --------------------------------------------------------------------------


def set_status(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``(seq, entry_id, is_declared)``."""
    new = latest(changes.select("seq", F.col("entry_id").alias("id"), F.col("is_declared").alias("_new")), ["id"])
    return entries.join(new.drop("seq"), "id", "left").select(
        *[c for c in entries.columns if c != "is_declared"],
        F.coalesce("_new", "is_declared").alias("is_declared"),
    )


def edit_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``(seq, entry_id, port, arrival_date, uploaded_files)``.

    A null file list keeps the stored one, an empty text clears it. Edits are folded per entry:
    last port and date, last file list that is not null.
    """
    new = changes.groupBy(F.col("entry_id").alias("id")).agg(
        F.max_by(F.struct("port", "arrival_date"), "seq").alias("_new"),
        F.max_by("uploaded_files", F.when(F.col("uploaded_files").isNotNull(), F.col("seq"))).alias("_files"),
    )
    return entries.join(new, "id", "left").select(
        "id",
        "voyage_id",
        F.when(F.col("_new").isNotNull(), F.col("_new.port")).otherwise(F.col("port")).alias("port"),
        F.when(F.col("_new").isNotNull(), F.col("_new.arrival_date"))
        .otherwise(F.col("arrival_date"))
        .alias("arrival_date"),
        "is_declared",
        F.coalesce("_files", "uploaded_files").alias("uploaded_files"),
    )


def checked_files(edits: DataFrame) -> DataFrame:
    """Replace ``uploaded_files`` by null where no checklist applies, so that an edit keeps it."""
    return edits.withColumn("uploaded_files", F.when(checklist_codes().isNotNull(), F.col("uploaded_files")))


def voyage_changes(edits: DataFrame, entries: DataFrame) -> DataFrame:
    """Voyage updates that follow from entry edits ``(seq, entry_id, voyage_number, service_name)``."""
    owner = entries.select(F.col("id").alias("entry_id"), "voyage_id")
    return edits.join(owner, "entry_id").select("seq", "voyage_id", "voyage_number", "service_name")


def delete_entries(entries: DataFrame, deletes: DataFrame) -> DataFrame:
    return entries.join(deletes.select(F.col("entry_id").alias("id")), "id", "left_anti")


# --- cloning ------------------------------------------------------------------------------------


def check_clones(voyages: DataFrame, entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each clone request ``(seq, voyage_id, voyage_number, start)``, start as text."""
    known = voyages.select(F.col("id").alias("voyage_id"), "vessel_id", "service_name")
    day = iso_date(F.col("start"))
    return (
        requests.join(known, "voyage_id", "left")
        .join(first_arrivals(entries), "voyage_id", "left")
        .withColumn("start_date", day)
        .withColumn(
            "message",
            F.when(F.col("vessel_id").isNull(), NO_VOYAGE)
            .when(F.col("first_arrival").isNull(), NO_ENTRIES)
            .when(F.col("start_date").isNull(), BAD_DATE)
            .otherwise(CLONED),
        )
        .withColumn("ok", F.col("message") == CLONED)
    )


def clone_voyages(
    voyages: DataFrame,
    entries: DataFrame,
    checked: DataFrame,
    last_voyage: int | None = None,
    last_entry: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clone the checked requests with shifted dates: new voyages, new entries, outcome per request.

    Clones are undeclared and have no file list. Entry ids follow the order of the requests and,
    inside one, the order of arrival. ``last_voyage`` and ``last_entry`` are the highest ids ever given.
    """
    good = checked.filter("ok").select(
        "seq",
        "voyage_id",
        "vessel_id",
        "voyage_number",
        "service_name",
        F.datediff("start_date", "first_arrival").alias("_shift"),
    )
    numbered = next_ids(good, voyages, "seq", last_voyage)
    new_voyages = numbered.select("id", "vessel_id", "voyage_number", "service_name", "seq")
    calls = entries.select("voyage_id", F.col("id").alias("_old_id"), "port", "arrival_date")
    rows = numbered.select("seq", "voyage_id", F.col("id").alias("_new_voyage"), "_shift").join(calls, "voyage_id")
    start = last_id_of(entries, last_entry)
    new_entries = number_all(rows, "_n", ["seq", "arrival_date", "_old_id"]).select(
        (F.col("_n") + start).alias("id"),
        F.col("_new_voyage").alias("voyage_id"),
        "port",
        F.date_add("arrival_date", F.col("_shift")).alias("arrival_date"),
        F.lit(False).alias("is_declared"),
        F.lit(None).cast("string").alias("uploaded_files"),
        "seq",
    )
    return new_voyages, new_entries, checked.select("seq", "voyage_id", "ok", "message")


# --- port mapping -------------------------------------------------------------------------------


def upsert_mapping(mapping: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert ``(seq, port, ref_num)``: both trimmed, both required. Returns mapping and rejects."""
    tidy = changes.select("seq", strip(F.col("port")).alias("port"), strip(F.col("ref_num")).alias("ref_num"))
    good = ~blank(F.col("port")) & ~blank(F.col("ref_num"))
    new = latest(tidy.filter(good), ["port"]).select("port", "ref_num")
    kept = mapping.join(new.select("port"), "port", "left_anti")
    return kept.unionByName(new), tidy.filter(~good).withColumn("message", F.lit("Both fields required."))


def delete_mapping(mapping: DataFrame, ports: DataFrame) -> DataFrame:
    return mapping.join(ports.select("port"), "port", "left_anti")
