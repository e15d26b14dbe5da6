"""Inserts, edits, deletes, clones and the port mapping over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.operators import changes as ops
from ensspark.plans.registry import query
from ensspark.plans.standin import AS_OF, AS_OF_SQL, PORTS, TRACKER_SQL, entries, pick, sql_list, table, tracker
from ensspark.plans.standin import vessels, voyages
from ensspark.session import land
from ensspark.sources.lookups import port_offices

WITH = f"WITH {TRACKER_SQL}"

# --- vessels: every third name exists, every third comes twice -----------------------------------

NEW_VESSELS_SQL = """new_vessels AS (
  SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Newbuild ' || (c_custkey // 6)
    ELSE 'Charter ' || c_custkey END AS name, CAST(c_custkey AS VARCHAR) AS imo_number FROM customer),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS nth,
    name IN (SELECT name FROM vessels) AS taken FROM new_vessels)"""


def new_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(key % 3 == 0, F.col("c_name"))
        .when(key % 3 == 1, F.concat(F.lit("Newbuild "), F.floor(key / 6).cast("string")))
        .otherwise(F.concat(F.lit("Charter "), key.cast("string")))
        .alias("name"),
        key.cast("string").alias("imo_number"),
    )


@query(
    "insert_vessels",
    f"""{WITH}, {NEW_VESSELS_SQL} SELECT (SELECT max(id) FROM vessels) + row_number() OVER (ORDER BY seq) AS id,
      name, imo_number, seq FROM ranked WHERE nth = 1 AND NOT taken""",
)
def insert_vessels(spark, sf_dir):
    return ops.insert_vessels(vessels(spark, sf_dir), new_vessels(spark, sf_dir))[0]


@query(
    "insert_vessels_rejects",
    f"""{WITH}, {NEW_VESSELS_SQL} SELECT seq, name, imo_number,
      'Vessel with this name already exists.' AS message FROM ranked WHERE nth > 1 OR taken""",
)
def insert_vessels_rejects(spark, sf_dir):
    return ops.insert_vessels(vessels(spark, sf_dir), new_vessels(spark, sf_dir))[1]


@query(
    "delete_vessels",
    f"""{WITH}, {NEW_VESSELS_SQL} SELECT DISTINCT name, taken AS found,
      CASE WHEN taken THEN 'Vessel deleted.' ELSE 'Vessel not found.' END AS message FROM ranked""",
)
def delete_vessels(spark, sf_dir):
    return ops.delete_vessels(vessels(spark, sf_dir), new_vessels(spark, sf_dir))[1]


# --- voyage submissions from orders and lineitem -------------------------------------------------

SUBMISSIONS_SQL = f"""submissions AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'Ghost'
      ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS vessel_name,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'N' || o_orderkey END AS voyage_number,
    o_orderpriority AS service_name FROM orders),
calls AS (
  SELECT l_orderkey AS seq, l_linenumber AS pos,
    CASE WHEN min(l_suppkey) % 9 = 0 THEN '' ELSE {sql_list(PORTS)}[min(l_suppkey) % {len(PORTS)} + 1] END AS port,
    CASE min(l_partkey) % 41 WHEN 0 THEN '31/12/1999' WHEN 1 THEN '1999-02-30' WHEN 2 THEN ''
      ELSE strftime(min(l_shipdate), '%Y-%m-%d') END AS arrival
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
used AS (SELECT *, TRY_CAST(try_strptime(arrival, '%Y-%m-%d') AS DATE) AS day FROM calls WHERE port <> ''),
tally AS (
  SELECT s.*, v.id AS vessel_id, coalesce(n_used, 0) AS n_used, coalesce(n_bad, 0) AS n_bad,
    coalesce(n_web_bad, 0) AS n_web_bad, coalesce(n_past, 0) AS n_past, coalesce(n_all, 0) AS n_all
  FROM submissions s
  LEFT JOIN vessels v ON v.name = s.vessel_name
  LEFT JOIN (SELECT seq, count(*) FILTER (arrival <> '') AS n_used,
      count(*) FILTER (arrival <> '' AND day IS NULL) AS n_bad, count(*) FILTER (day IS NULL) AS n_web_bad,
      count(*) FILTER (day < {AS_OF_SQL}) AS n_past FROM used GROUP BY seq) u ON u.seq = s.seq
  LEFT JOIN (SELECT seq, count(*) AS n_all FROM calls GROUP BY seq) a ON a.seq = s.seq),
good AS (SELECT *, (SELECT max(id) FROM voyages) + row_number() OVER (ORDER BY seq) AS id FROM tally
  WHERE vessel_name <> '' AND voyage_number IS NOT NULL AND vessel_id IS NOT NULL AND n_bad = 0 AND n_used > 0)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, owner = F.col("o_orderkey"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        F.when(key % 11 == 0, "")
        .when(key % 13 == 0, "Ghost")
        .otherwise(F.concat(F.lit("Customer#"), owner))
        .alias("vessel_name"),
        F.when(key % 17 != 0, F.concat(F.lit("N"), key.cast("string"))).alias("voyage_number"),
        F.col("o_orderpriority").alias("service_name"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("supp"), F.min("l_partkey").alias("part"), F.min("l_shipdate").alias("ship")
    )
    supp, part = F.col("supp"), F.col("part")
    return lines.select(
        F.col("l_orderkey").alias("seq"),
        F.col("l_linenumber").alias("pos"),
        F.when(supp % 9 == 0, "").otherwise(pick(PORTS, supp % len(PORTS))).alias("port"),
        F.when(part % 41 == 0, "31/12/1999")
        .when(part % 41 == 1, "1999-02-30")
        .when(part % 41 == 2, "")
        .otherwise(F.date_format("ship", "yyyy-MM-dd"))
        .alias("arrival"),
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.check_submissions(submissions(spark, sf_dir), calls(spark, sf_dir), vessels(spark, sf_dir))


def _inserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    checked = land(_checked(spark, sf_dir), "submissions")
    return ops.insert_voyages(voyages(spark, sf_dir), entries(spark, sf_dir), checked, calls(spark, sf_dir))


REASONS = """concat_ws(';', CASE WHEN vessel_name = '' THEN 'vessel required' END,
  CASE WHEN voyage_number IS NULL THEN 'voyage number required' END,
  CASE WHEN vessel_name <> '' AND vessel_id IS NULL THEN 'vessel unknown' END, {rest}) AS reasons"""


@query(
    "submission_reasons",
    f"""{WITH}, {SUBMISSIONS_SQL} SELECT seq, {REASONS.format(rest='''
      CASE WHEN n_bad > 0 THEN 'invalid date' END, CASE WHEN n_used = 0 THEN 'no port call' END''')} FROM tally""",
)
def submission_reasons(spark, sf_dir):
    return _checked(spark, sf_dir).select("seq", F.array_join("reasons", ";").alias("reasons"))


@query(
    "submission_reasons_web",
    f"""{WITH}, {SUBMISSIONS_SQL} SELECT seq, {REASONS.format(rest='''
      CASE WHEN n_web_bad > 0 THEN 'invalid date' END, CASE WHEN n_past > 0 THEN 'arrival in the past' END,
      CASE WHEN n_all > 3 THEN 'too many port calls' END''')} FROM tally""",
)
def submission_reasons_web(spark, sf_dir):
    checked = ops.check_submissions(
        submissions(spark, sf_dir),
        calls(spark, sf_dir),
        vessels(spark, sf_dir),
        web=True,
        as_of=AS_OF,
        max_calls=3,
    )
    return checked.select("seq", F.array_join("reasons", ";").alias("reasons"))


@query(
    "insert_voyages",
    f"{WITH}, {SUBMISSIONS_SQL} SELECT id, vessel_id, voyage_number, service_name, seq FROM good",
)
def insert_voyages(spark, sf_dir):
    return _inserted(spark, sf_dir)[0]


@query(
    "insert_entries",
    f"""{WITH}, {SUBMISSIONS_SQL} SELECT
        (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY u.seq, u.pos) AS id, g.id AS voyage_id, u.port,
        u.day AS arrival_date, FALSE AS is_declared, '' AS uploaded_files, u.seq
      FROM used u JOIN good g ON g.seq = u.seq WHERE u.arrival <> ''""",
)
def insert_entries(spark, sf_dir):
    return _inserted(spark, sf_dir)[1]


# --- changes from the event stream ---------------------------------------------------------------

CHANGES_SQL = f"""changes AS (
  SELECT event_id AS seq, user_id * 10 + 1 + event_id % 7 AS entry_id, event_type, value,
    {sql_list(PORTS)}[event_id % {len(PORTS)} + 1] AS port, CAST(ts AS DATE) AS arrival_date,
    CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'CYLMS,ITSAL' END AS uploaded_files,
    'E' || event_id AS voyage_number, CASE event_id % 4 WHEN 0 THEN '' ELSE 'S' || (event_id % 4) END AS service_name
  FROM events)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("seq"),
        (F.col("user_id") * 10 + 1 + event % 7).alias("entry_id"),
        "event_type",
        pick(PORTS, event % len(PORTS)).alias("port"),
        F.col("ts").cast("date").alias("arrival_date"),
        F.when(event % 3 == 1, "").when(event % 3 == 2, "CYLMS,ITSAL").alias("uploaded_files"),
        F.concat(F.lit("E"), event.cast("string")).alias("voyage_number"),
        F.when(event % 4 == 0, "").otherwise(F.concat(F.lit("S"), (event % 4).cast("string"))).alias("service_name"),
    )


@query(
    "apply_status",
    f"""{WITH}, {CHANGES_SQL} SELECT e.id, voyage_id, port, arrival_date, uploaded_files,
        coalesce(c.declared, e.is_declared) AS is_declared
      FROM entries e LEFT JOIN (SELECT entry_id, arg_max(event_type = 'purchase', seq) AS declared
        FROM changes GROUP BY entry_id) c ON c.entry_id = e.id""",
)
def apply_status(spark, sf_dir):
    status = changes(spark, sf_dir).withColumn("is_declared", F.col("event_type") == "purchase")
    return ops.set_status(entries(spark, sf_dir), status)


@query(
    "apply_edits",
    f"""{WITH}, {CHANGES_SQL} SELECT e.id, voyage_id, coalesce(c.port, e.port) AS port,
        coalesce(c.arrival_date, e.arrival_date) AS arrival_date, is_declared,
        coalesce(c.files, e.uploaded_files) AS uploaded_files
      FROM entries e LEFT JOIN (SELECT entry_id, arg_max(port, seq) AS port, arg_max(arrival_date, seq) AS arrival_date,
        arg_max(uploaded_files, seq) FILTER (uploaded_files IS NOT NULL) AS files
        FROM changes GROUP BY entry_id) c ON c.entry_id = e.id""",
)
def apply_edits(spark, sf_dir):
    return ops.edit_entries(entries(spark, sf_dir), changes(spark, sf_dir))


@query(
    "apply_checked_edits",
    f"""{WITH}, {CHANGES_SQL}, edits AS (SELECT entry_id, seq, port, arrival_date, CASE WHEN seq % 2 = 0
        AND port IN ('GBLIV', 'IEDUB') THEN uploaded_files END AS uploaded_files FROM changes)
      SELECT e.id, voyage_id, coalesce(c.port, e.port) AS port,
        coalesce(c.arrival_date, e.arrival_date) AS arrival_date, is_declared,
        coalesce(c.files, e.uploaded_files) AS uploaded_files
      FROM entries e LEFT JOIN (SELECT entry_id, arg_max(port, seq) AS port, arg_max(arrival_date, seq) AS arrival_date,
        arg_max(uploaded_files, seq) FILTER (uploaded_files IS NOT NULL) AS files
        FROM edits GROUP BY entry_id) c ON c.entry_id = e.id""",
)
def apply_checked_edits(spark, sf_dir):
    """Edits keep the stored file list where no checklist applies."""
    service = F.when(F.col("seq") % 2 == 0, "West Coast UK").otherwise("Adriatic")
    edits = ops.checked_files(changes(spark, sf_dir).withColumn("service_name", service))
    return ops.edit_entries(entries(spark, sf_dir), edits)


@query(
    "apply_voyage_edits",
    f"""{WITH}, {CHANGES_SQL}, per_voyage AS (
        SELECT e.voyage_id, arg_max(c.voyage_number, c.seq) AS number,
          arg_max(c.service_name, c.seq) FILTER (c.service_name <> '') AS service
        FROM changes c JOIN entries e ON e.id = c.entry_id GROUP BY e.voyage_id)
      SELECT v.id, v.vessel_id, coalesce(number, voyage_number) AS voyage_number,
        coalesce(service, service_name) AS service_name
      FROM voyages v LEFT JOIN per_voyage p ON p.voyage_id = v.id""",
)
def apply_voyage_edits(spark, sf_dir):
    edits = ops.voyage_changes(changes(spark, sf_dir), entries(spark, sf_dir))
    return ops.update_voyages(voyages(spark, sf_dir), edits)


@query(
    "delete_rows",
    f"""{WITH}, {CHANGES_SQL} SELECT * FROM entries
      WHERE id NOT IN (SELECT entry_id FROM changes WHERE event_type = 'error')""",
)
def delete_rows(spark, sf_dir):
    gone = changes(spark, sf_dir).filter("event_type = 'error'")
    return ops.delete_entries(entries(spark, sf_dir), gone)


# --- clones: one request per customer, some for voyages that do not exist -------------------------

CLONES_SQL = f"""requests AS (
  SELECT c_custkey AS seq, c_custkey * 11 AS voyage_id, 'C' || c_custkey AS voyage_number,
    CASE WHEN c_custkey % 19 = 0 THEN 'soon' ELSE strftime({AS_OF_SQL} + CAST(c_custkey % 400 AS INTEGER), '%Y-%m-%d')
      END AS start FROM customer),
firsts AS (SELECT voyage_id, min(arrival_date) AS first_arrival FROM entries GROUP BY voyage_id),
checked AS (
  SELECT r.*, v.vessel_id, v.service_name, f.first_arrival,
    TRY_CAST(try_strptime(r.start, '%Y-%m-%d') AS DATE) AS start_date
  FROM requests r LEFT JOIN voyages v ON v.id = r.voyage_id LEFT JOIN firsts f ON f.voyage_id = r.voyage_id),
good AS (SELECT *, (SELECT max(id) FROM voyages) + row_number() OVER (ORDER BY seq) AS id FROM checked
  WHERE vessel_id IS NOT NULL AND first_arrival IS NOT NULL AND start_date IS NOT NULL)"""


def _clones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("c_custkey")
    day = F.date_add(F.lit(AS_OF), (key % 400).cast("int"))
    requests = table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        (key * 11).alias("voyage_id"),
        F.concat(F.lit("C"), key.cast("string")).alias("voyage_number"),
        F.when(key % 19 == 0, "soon").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("start"),
    )
    checked = land(ops.check_clones(voyages(spark, sf_dir), entries(spark, sf_dir), requests), "clones")
    return ops.clone_voyages(voyages(spark, sf_dir), entries(spark, sf_dir), checked)


@query(
    "clone_voyages",
    f"{WITH}, {CLONES_SQL} SELECT id, vessel_id, voyage_number, service_name, seq FROM good",
)
def clone_voyages(spark, sf_dir):
    return _clones(spark, sf_dir)[0]


@query(
    "clone_entries",
    f"""{WITH}, {CLONES_SQL} SELECT
        (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY g.seq, e.arrival_date, e.id) AS id,
        g.id AS voyage_id, e.port,
        e.arrival_date + CAST(g.start_date - g.first_arrival AS INTEGER) AS arrival_date,
        FALSE AS is_declared, CAST(NULL AS VARCHAR) AS uploaded_files, g.seq
      FROM good g JOIN entries e ON e.voyage_id = g.voyage_id""",
)
def clone_entries(spark, sf_dir):
    return _clones(spark, sf_dir)[1]


@query(
    "clone_results",
    f"""{WITH}, {CLONES_SQL}, told AS (SELECT seq, voyage_id, CASE
        WHEN vessel_id IS NULL THEN 'Original voyage not found.'
        WHEN first_arrival IS NULL THEN 'Original voyage has no entries to clone.'
        WHEN start_date IS NULL THEN 'Invalid date format.' ELSE 'Voyage cloned successfully.' END AS message FROM checked)
      SELECT *, message = 'Voyage cloned successfully.' AS ok FROM told""",
)
def clone_results(spark, sf_dir):
    return _clones(spark, sf_dir)[2]


# --- port mapping ---------------------------------------------------------------------------------

MAPPING_SQL = """mapping(port, ref_num) AS (VALUES ('CYLMS', 'CY000510'), ('ITSAL', 'IT084100'), ('ESCAS', 'ES999811'),
  ('PTLEI', 'PT000340'), ('GBLIV', 'GB000080'), ('IEDUB', 'IEDUB100'), ('BEANR', 'BE101000'), ('FRMRS', 'FR002730'),
  ('ESBCN', 'ES000811'), ('ITGOA', 'IT261101'), ('TRALI', 'TR330100'), ('MACAS', 'ES001211'), ('ITRAV', 'IT081100'),
  ('ITVCE', 'IT091100'))"""

MAPPING_CHANGES_SQL = f"""{MAPPING_SQL},
changed AS (
  SELECT c_custkey AS seq,
    trim(CASE WHEN c_custkey % 5 = 0 THEN ' GBLIV ' WHEN c_custkey % 7 = 0 THEN '  ' ELSE 'P' || (c_custkey % 1000) END) AS port,
    trim(CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ' R' || c_custkey END) AS ref_num FROM customer)"""


def _mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(key % 5 == 0, " GBLIV ")
        .when(key % 7 == 0, "  ")
        .otherwise(F.concat(F.lit("P"), (key % 1000).cast("string")))
        .alias("port"),
        F.when(key % 9 == 0, "").otherwise(F.concat(F.lit(" R"), key.cast("string"))).alias("ref_num"),
    )
    return ops.upsert_mapping(port_offices(spark), new)


@query(
    "mapping_upsert",
    f"""WITH {MAPPING_CHANGES_SQL}, valid AS (SELECT port, arg_max(ref_num, seq) AS ref_num FROM changed
        WHERE port <> '' AND ref_num <> '' GROUP BY port)
      SELECT port, ref_num FROM valid
      UNION ALL SELECT port, ref_num FROM mapping WHERE port NOT IN (SELECT port FROM valid)""",
)
def mapping_upsert(spark, sf_dir):
    return _mapping(spark, sf_dir)[0]


@query(
    "mapping_rejects",
    f"""WITH {MAPPING_CHANGES_SQL} SELECT seq, port, ref_num, 'Both fields required.' AS message FROM changed
      WHERE port = '' OR ref_num = ''""",
)
def mapping_rejects(spark, sf_dir):
    return _mapping(spark, sf_dir)[1]


@query(
    "mapping_delete",
    f"""WITH {MAPPING_SQL} SELECT * FROM mapping
      WHERE port NOT IN (SELECT {sql_list(PORTS)}[s_suppkey % {len(PORTS)} + 1] AS p FROM supplier GROUP BY p
        HAVING count(*) FILTER (s_acctbal < 0) % 2 = 0)""",
)
def mapping_delete(spark, sf_dir):
    """Ports go whose suppliers in debt are even in number."""
    port = pick(PORTS, F.col("s_suppkey") % len(PORTS)).alias("port")
    debts = table(spark, sf_dir, "supplier").groupBy(port).agg(F.count_if(F.col("s_acctbal") < 0).alias("n"))
    return ops.delete_mapping(port_offices(spark), debts.filter("n % 2 = 0").select("port"))
