"""Tracker list, dashboard, export and lookups over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.operators import tracker as ops
from ensspark.plans.registry import query
from ensspark.plans.standin import AS_OF, AS_OF_SQL, TRACKER_SQL, table, tracker, vessels

WITH = f"WITH {TRACKER_SQL}"
ALERT_SQL = f"""CASE WHEN is_declared THEN 'completed' WHEN arrival_date - {AS_OF_SQL} <= 2 THEN 'urgent'
  WHEN arrival_date - {AS_OF_SQL} <= 5 THEN 'warning' ELSE 'completed' END"""


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.voyage_details(*tracker(spark, sf_dir))


@query("voyage_details", f"{WITH} SELECT * FROM details ORDER BY arrival_date DESC, entry_id")
def voyage_details(spark, sf_dir):
    return ops.latest_first(details(spark, sf_dir))


@query(
    "voyage_details_alerts",
    f"{WITH} SELECT *, {ALERT_SQL} AS alert FROM details WHERE arrival_date >= {AS_OF_SQL}",
)
def voyage_details_alerts(spark, sf_dir):
    """Which port calls are still ahead, and how urgent are they?"""
    return ops.latest_first(ops.with_alerts(ops.hide_past(details(spark, sf_dir), AS_OF), AS_OF))


@query(
    "voyage_list",
    f"""{WITH} SELECT entry_id, vessel_name, service_name, voyage_number, port, arrival_date,
      CASE WHEN is_declared THEN 'YES' ELSE 'NO' END AS declared, {ALERT_SQL} AS alert FROM details""",
)
def voyage_list(spark, sf_dir):
    return ops.list_rows(details(spark, sf_dir), AS_OF)


@query(
    "search_filter",
    f"""{WITH} SELECT * FROM details
      WHERE contains(lower(vessel_name), 'v42') OR contains(lower(voyage_number), 'v42')""",
)
def search_filter(spark, sf_dir):
    return ops.filtered(details(spark, sf_dir), AS_OF, term="V42", show_past=True)


@query(
    "search_regex",
    f"""{WITH} SELECT * FROM details WHERE (regexp_matches(lower(vessel_name), '[0-9]7$|^v1.3$')
      OR regexp_matches(lower(voyage_number), '[0-9]7$|^v1.3$')) AND arrival_date >= {AS_OF_SQL}""",
)
def search_regex(spark, sf_dir):
    return ops.filtered(details(spark, sf_dir), AS_OF, term="[0-9]7$|^V1.3$", regex=True)


@query(
    "port_service_filter",
    f"""{WITH} SELECT * FROM details WHERE port = 'GBLIV' AND service_name = 'West Coast UK'
      AND arrival_date >= {AS_OF_SQL}""",
)
def port_service_filter(spark, sf_dir):
    return ops.filtered(details(spark, sf_dir), AS_OF, port="GBLIV", service="West Coast UK")


@query(
    "upcoming_7d",
    f"""{WITH} SELECT vessel_name AS vessel, voyage_number, service_name, port, arrival_date, entry_id
      FROM details WHERE arrival_date BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + 7""",
)
def upcoming_7d(spark, sf_dir):
    return ops.soonest_first(ops.upcoming(*tracker(spark, sf_dir), AS_OF, 7))


@query(
    "dashboard_kpis",
    f"""{WITH} SELECT count(DISTINCT voyage_number) AS active_voyages,
      count(*) FILTER (arrival_date BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + 7) AS upcoming_arrivals FROM details""",
)
def dashboard_kpis(spark, sf_dir):
    return ops.dashboard(*tracker(spark, sf_dir), AS_OF, 7)


@query(
    "export_rows",
    f"""{WITH} SELECT vessel_name AS "Vessel", voyage_number AS "Voyage", service_name AS "Service",
      port AS "Port", arrival_date AS "Arrival Date",
      CASE WHEN is_declared THEN 'Yes' ELSE 'No' END AS "Declared", uploaded_files AS "Files"
      FROM details WHERE arrival_date >= {AS_OF_SQL}""",
)
def export_rows(spark, sf_dir):
    return ops.export_rows(ops.filtered(details(spark, sf_dir), AS_OF))


@query(
    "voyage_entries",
    f"{WITH} SELECT voyage_id, id AS entry_id, port, arrival_date FROM entries",
)
def voyage_entries(spark, sf_dir):
    return ops.voyage_entries(tracker(spark, sf_dir)[2])


@query(
    "arrival_offsets",
    f"""{WITH} SELECT id AS entry_id, voyage_id, port, arrival_date,
      CAST(arrival_date - min(arrival_date) OVER (PARTITION BY voyage_id) AS INTEGER) AS day_offset FROM entries""",
)
def arrival_offsets(spark, sf_dir):
    return ops.arrival_offsets(tracker(spark, sf_dir)[2])


@query(
    "vessel_lookup",
    f"""{WITH}, requests AS (SELECT o_orderkey AS request_id,
      CASE WHEN o_orderkey % 7 = 0 THEN 'Vessel ' || o_orderkey
      ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS vessel_name FROM orders)
      SELECT request_id, vessel_name, coalesce(imo_number, '') AS imo
      FROM requests LEFT JOIN vessels ON name = vessel_name""",
)
def vessel_lookup(spark, sf_dir):
    key, owner = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    requests = table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 7 == 0, F.concat(F.lit("Vessel "), key.cast("string")))
        .otherwise(F.concat(F.lit("Customer#"), F.lpad(owner, 9, "0")))
        .alias("vessel_name"),
    )
    return ops.imo_lookup(requests, vessels(spark, sf_dir)).select("request_id", "vessel_name", "imo")


@query(
    "checklist",
    f"""{WITH}, listed AS (SELECT entry_id, port, uploaded_files, CASE port
        WHEN 'GBLIV' THEN ['CYLMS','ILHFA','ILASH','TRISK','EGALY','ITSAL','ESCAS','PTLEI']
        ELSE ['CYLMS','ILHFA','ILASH','TRISK','EGALY','ITSAL','ESCAS','PTLEI','GBLIV'] END AS codes
      FROM details WHERE service_name = 'West Coast UK' AND port IN ('GBLIV', 'IEDUB'))
      SELECT entry_id, port, code, list_contains(
        list_transform(string_split(coalesce(uploaded_files, ''), ','), lambda x: trim(x)), code) AS ticked
      FROM (SELECT *, unnest(codes) AS code FROM listed)""",
)
def checklist(spark, sf_dir):
    return ops.checklist(details(spark, sf_dir))


@query(
    "orphans",
    f"""{WITH}, left_vessels AS (SELECT id FROM vessels JOIN customer ON id = c_custkey
        WHERE c_mktsegment <> 'MACHINERY'),
      lost AS (SELECT id FROM voyages WHERE vessel_id NOT IN (SELECT id FROM left_vessels))
      SELECT 'voyage' AS kind, id, 'no vessel' AS reason FROM lost
      UNION ALL SELECT 'voyage', id, 'no entries' FROM voyages WHERE id NOT IN (SELECT voyage_id FROM entries)
      UNION ALL SELECT 'entry', id, 'no vessel' FROM entries WHERE voyage_id IN (SELECT id FROM lost)
      UNION ALL SELECT 'entry', id, 'no voyage' FROM entries WHERE voyage_id NOT IN (SELECT id FROM voyages)""",
)
def orphans(spark, sf_dir):
    """Rows the detail list hides once the machinery vessels are deleted."""
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_name").alias("name"))
    ves, voy, ent = tracker(spark, sf_dir)
    return ops.hidden_rows(ves.join(gone, "name", "left_anti"), voy, ent)
