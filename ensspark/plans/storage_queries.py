"""What is written and read again: tables with faults, older tables, folders of documents, queues, logs and exports.

Every query writes rows of the stand-ins below the shared folder, then reads them with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark import sinks
from ensspark.functions.values import csv_to_list, list_to_csv, relative_path
from ensspark.operators import changes, headers, tracker
from ensspark.operators.headers import DECL
from ensspark.plans import declarations as decl
from ensspark.plans.change_queries import MAPPING_CHANGES_SQL, NEW_VESSELS_SQL, mapping_upsert, new_vessels
from ensspark.plans.declarations import DOCS_SQL, ROUTES_SQL
from ensspark.plans.document_queries import ITEM_SQL, tariff_report
from ensspark.plans.filing_queries import EMPTY_SQL, GB_TIN, UPDATE_SQL, update_documents
from ensspark.plans.registry import query
from ensspark.plans.standin import AS_OF, AS_OF_SQL, TRACKER_SQL, entries, pick, sql_list, table, vessels, voyages
from ensspark.plans.standin import tracker as tracker_tables
from ensspark.schemas import GB_FOLDERS, IMO_FLAGS
from ensspark.session import shared_dir
from ensspark.sources import declarations as source
from ensspark.sources import settings, tables
from ensspark.sources.lookups import vessel_routes

WITH = f"WITH {TRACKER_SQL}"

# --- tracker tables -------------------------------------------------------------------------------


@query(
    "store_violations",
    f"""{WITH}, ves AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 37 = 0 THEN 'Twin' ELSE name END AS name
        FROM vessels WHERE id % 41 <> 0),
      voy AS (SELECT id, CASE WHEN id % 61 <> 0 THEN vessel_id END AS vessel_id,
        CASE WHEN id % 67 <> 0 THEN voyage_number END AS voyage_number FROM voyages WHERE id % 43 <> 0),
      ent AS (SELECT id, CASE WHEN id % 79 <> 0 THEN voyage_id END AS voyage_id, CASE WHEN id % 71 <> 0 THEN port END AS port,
        CASE WHEN id % 73 <> 0 THEN arrival_date END AS arrival_date FROM entries)
      SELECT 'vessels' AS table_name, id, 'name is null' AS rule FROM ves WHERE name IS NULL
      UNION ALL SELECT 'vessels', min(id), 'name is not unique' FROM ves WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1
      UNION ALL SELECT 'voyages', id, 'vessel_id is null' FROM voy WHERE vessel_id IS NULL
      UNION ALL SELECT 'voyages', id, 'voyage_number is null' FROM voy WHERE voyage_number IS NULL
      UNION ALL SELECT 'voyages', id, 'vessel_id has no parent' FROM voy WHERE vessel_id NOT IN (SELECT id FROM ves)
      UNION ALL SELECT 'entries', id, 'voyage_id is null' FROM ent WHERE voyage_id IS NULL
      UNION ALL SELECT 'entries', id, 'port is null' FROM ent WHERE port IS NULL
      UNION ALL SELECT 'entries', id, 'arrival_date is null' FROM ent WHERE arrival_date IS NULL
      UNION ALL SELECT 'entries', id, 'voyage_id has no parent' FROM ent WHERE voyage_id NOT IN (SELECT id FROM voy)""",
)
def store_violations(spark, sf_dir):
    """Rows of damaged tables that break a declared constraint."""
    key = F.col("id")

    def without(name: str, n: int):
        return F.when(key % n != 0, F.col(name))

    twin = F.when(key % 50 == 0, None).when(key % 37 == 0, "Twin").otherwise(F.col("name"))
    ves = vessels(spark, sf_dir).filter(key % 41 != 0).withColumn("name", twin)
    voy = voyages(spark, sf_dir).filter(key % 43 != 0)
    voy = voy.withColumns({"vessel_id": without("vessel_id", 61), "voyage_number": without("voyage_number", 67)})
    lost = {"voyage_id": without("voyage_id", 79), "port": without("port", 71), "arrival_date": without("arrival_date", 73)}
    return tables.violations(ves, voy, entries(spark, sf_dir).withColumns(lost))


@query(
    "evolved_entries",
    f"""{WITH} SELECT id, voyage_id, port, arrival_date, coalesce(CASE WHEN id % 5 <> 0 THEN is_declared END, FALSE) AS is_declared,
      CASE WHEN id % 2 = 0 THEN uploaded_files END AS uploaded_files FROM entries""",
)
def evolved_entries(spark, sf_dir):
    """Entries stored partly before the column of file lists was added."""
    path = shared_dir(spark, "entries")
    rows = entries(spark, sf_dir).withColumn("is_declared", F.when(F.col("id") % 5 != 0, F.col("is_declared")))
    rows.filter("id % 2 <> 0").drop("uploaded_files").write.parquet(path)
    rows.filter("id % 2 = 0").write.mode("append").parquet(path)
    return tables.read_entries(spark, path)


@query(
    "kept_vessels",
    f"{WITH}, {NEW_VESSELS_SQL} SELECT * FROM vessels WHERE name NOT IN (SELECT name FROM new_vessels)",
)
def kept_vessels(spark, sf_dir):
    """The vessels that a deletion by name leaves."""
    kept = changes.delete_vessels(vessels(spark, sf_dir), new_vessels(spark, sf_dir))[0]
    return kept.select("id", "name", "imo_number")


@query(
    "found_vessel",
    f"{WITH} SELECT id, name, imo_number FROM vessels WHERE name = 'Customer#000000007' ORDER BY id LIMIT 1",
)
def found_vessel(spark, sf_dir):
    return tracker.find_vessel(vessels(spark, sf_dir), "Customer#000000007")


@query(
    "file_lists",
    f"""{WITH} SELECT id, array_to_string(list_filter(list_transform(string_split(coalesce(uploaded_files, ''), ','),
      lambda x: trim(x)), lambda x: x <> ''), ',') AS files FROM entries""",
)
def file_lists(spark, sf_dir):
    """File lists without blanks and empty codes, as they are stored."""
    return entries(spark, sf_dir).select("id", list_to_csv(csv_to_list(F.col("uploaded_files"))).alias("files"))


@query(
    "export_file",
    f"""{WITH} SELECT vessel_name AS "Vessel", voyage_number AS "Voyage", coalesce(service_name, '') AS "Service", port AS "Port",
      CAST(arrival_date AS VARCHAR) AS "Arrival Date", CASE WHEN is_declared THEN 'Yes' ELSE 'No' END AS "Declared",
      coalesce(uploaded_files, '') AS "Files" FROM details WHERE arrival_date >= {AS_OF_SQL}""",
)
def export_file(spark, sf_dir):
    """The export as its file holds it; CSV does not tell an empty value from a missing one."""
    path = shared_dir(spark, "export")
    details = tracker.voyage_details(*tracker_tables(spark, sf_dir))
    sinks.write_export(tracker.filtered(details, AS_OF), path)
    return spark.read.option("header", True).csv(path).na.fill("")


# --- mapping and report ---------------------------------------------------------------------------


@query(
    "mapping_store",
    f"""WITH {MAPPING_CHANGES_SQL}, valid AS (SELECT port, arg_max(ref_num, seq) AS ref_num FROM changed
        WHERE port <> '' AND ref_num <> '' GROUP BY port)
      SELECT port, ref_num FROM valid UNION ALL SELECT port, ref_num FROM mapping WHERE port NOT IN (SELECT port FROM valid)""",
)
def mapping_store(spark, sf_dir):
    path = shared_dir(spark, "mapping")
    settings.write_mapping(mapping_upsert(spark, sf_dir), path)
    return settings.read_mapping(spark, path)


@query(
    "report_file",
    f"""WITH {ITEM_SQL} SELECT min(reference) AS reference FROM verdicts
      WHERE items = 0 OR failed_items > 0 GROUP BY lower(reference)""",
)
def report_file(spark, sf_dir):
    path = shared_dir(spark, "report")
    sinks.write_report(tariff_report(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("reference"))


# --- folders of documents -------------------------------------------------------------------------

SHIPS = ["CYLM", "EGAL", "ILHF", "ITSA"]
CHOSEN = SHIPS[:2]


def _ship_folders(spark: SparkSession, sf_dir: str) -> str:
    """Documents in one folder per ship, two levels below the root."""
    root = shared_dir(spark, "ships")
    docs = decl.documents(spark, sf_dir)
    for i, ship in enumerate(SHIPS):
        sinks.write_declaration_files(docs.filter(F.col("doc") % len(SHIPS) == i), f"{root}/queue/{ship}", sinks.TEXT_DOCUMENTS)
    return root


@query(
    "chosen_folders",
    f"""WITH {DOCS_SQL} SELECT lrn, {sql_list(SHIPS)}[k % {len(SHIPS)} + 1] AS folder FROM docs
      WHERE k % {len(SHIPS)} < {len(CHOSEN)}""",
)
def chosen_folders(spark, sf_dir):
    """Documents found below a root, of the folders that the user chose; one of them does not exist."""
    found = source.read_declarations(spark, _ship_folders(spark, sf_dir), folders=[*CHOSEN, "NONE"])
    good, _ = source.split_corrupt(found)
    return good.select(F.col(DECL)["LocalReferenceNumber"].alias("lrn"), "folder")


@query(
    "whole_texts",
    f"""WITH {DOCS_SQL} SELECT 'queue/' || {sql_list(SHIPS)}[k % {len(SHIPS)} + 1] AS place, CAST(count(*) AS BIGINT) AS documents
      FROM docs GROUP BY ALL""",
)
def whole_texts(spark, sf_dir):
    """How many documents the whole texts of each folder hold, by the folder's path below the root."""
    root = _ship_folders(spark, sf_dir)
    texts = source.read_documents(spark, root)
    plain = F.regexp_replace("file_path", "^file:/+", "/")
    inside = relative_path(plain, root.removeprefix("file://"))
    place = F.regexp_replace(inside, "/[^/]*$", "")
    documents = F.regexp_count("xml", F.lit("<LocalReferenceNumber>"))
    return texts.groupBy(place.alias("place")).agg(F.sum(documents).cast("long").alias("documents"))


CODES = [*IMO_FLAGS][:8]
CODE_SQL = """coded AS (SELECT o_orderkey AS doc, o_orderkey || '.xml' AS file_name,
    '/ships/' || CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 'S' END || 'h' || lpad(CAST(o_orderkey % 11 AS VARCHAR), 2, '0')
      || CASE WHEN o_orderkey % 3 = 0 THEN ' V123/' ELSE '' END AS path,
    o_orderkey % 11 AS n FROM orders)"""


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    path = F.concat(
        F.lit("/ships/"),
        F.when(key % 2 == 0, "s").otherwise("S"),
        F.lit("h"),
        decl.digits(key % 11, 2),
        F.when(key % 3 == 0, " V123/").otherwise(""),
    )
    files = table(spark, sf_dir, "orders").select(key.alias("doc"), decl.join(key, ".xml").alias("file_name"), path.alias("path"))
    codes = spark.range(9).select(
        decl.join("sh", decl.digits(F.col("id"), 2)).alias("code"), F.when(F.col("id") < 8, pick(CODES, F.col("id") % 8)).alias("imo")
    )
    return source.with_imo(files, codes, F.col("path"))


@query("vessel_codes", f"WITH {CODE_SQL} SELECT doc, file_name, path, {sql_list(CODES)}[n + 1] AS imo FROM coded WHERE n < 8")
def vessel_codes(spark, sf_dir):
    """Documents with the IMO that their folder's vessel code stands for."""
    return _coded(spark, sf_dir)[0].select("doc", "file_name", "path", "imo")


@query(
    "processing_log",
    f"""WITH {CODE_SQL} SELECT file_name, 'vessel' AS stage, 'no IMO for vessel code SH' || lpad(CAST(n AS VARCHAR), 2, '0') AS reason
      FROM coded WHERE n >= 8""",
)
def processing_log(spark, sf_dir):
    """Log lines of the documents without a vessel, appended by two runs."""
    path = shared_dir(spark, "log")
    missed = _coded(spark, sf_dir)[1]
    for part in ("file_name LIKE '%0.xml'", "file_name NOT LIKE '%0.xml'"):
        sinks.write_rejects(missed.filter(part), path)
    return spark.read.parquet(path).select("file_name", "stage", "reason")


@query("changed_files", f"WITH {UPDATE_SQL} SELECT 'D' || doc || '.xml' AS file_name FROM updated WHERE changed")
def changed_files(spark, sf_dir):
    """The documents that a header update rewrites; the others are not written."""
    path = shared_dir(spark, "changed")
    sinks.write_declarations(update_documents(spark, sf_dir), path)
    return spark.read.parquet(path).filter(F.contains("xml", F.lit("LocalReferenceNumber"))).select("file_name")


# --- parties of filings ---------------------------------------------------------------------------


@query(
    "filing_party",
    """WITH party AS (SELECT o_orderkey AS k, o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN ' José' WHEN 1 THEN ' Joseé#1' ELSE ' Ann' END AS name,
        'Straße ' || (o_orderkey % 9) AS street, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '7*' WHEN 2 THEN '7' END AS number FROM orders)
      SELECT k AS doc, CASE WHEN k % 3 = 1 THEN strip_accents(replace(name, '#', '')) ELSE name END AS name,
        replace(street, 'ß', '') AS street, coalesce(nullif(replace(number, '*', ''), ''), 'N/A') AS number FROM party""",
)
def filing_party(spark, sf_dir):
    """Parties of filings: texts change where a character has to go, not for an accent alone."""
    key = F.col("o_orderkey")
    name = decl.join(key, F.when(key % 3 == 0, " José").when(key % 3 == 1, " Joseé#1").otherwise(" Ann"))
    number = F.when(key % 4 == 0, "").when(key % 4 == 1, "7*").when(key % 4 == 2, "7")
    blank = F.lit(None).cast("string")
    address = F.struct(
        blank.alias("city"),
        F.lit("DE").alias("country"),
        decl.join("Straße ", key % 9).alias("street"),
        F.lit("10115").alias("postCode"),
        number.alias("number"),
    )
    party = F.struct(name.alias("name"), address.alias("Address"))
    rows = table(spark, sf_dir, "orders").select(key.alias("doc"), headers.clean_f10_party(party).alias("p"))
    return rows.select("doc", "p.name", "p.Address.street", "p.Address.number")


# --- GB preparation -------------------------------------------------------------------------------


@query(
    "gb_preparation",
    f"""WITH {DOCS_SQL}, {ROUTES_SQL}, placed AS (SELECT docs.*, list_position(ports, 'GBLIV') AS gb,
        list_position(ports, CASE WHEN pou = 'GBBEL' THEN 'GBLIV' ELSE pou END) AS place FROM docs LEFT JOIN routes ON routes.imo = docs.imo)
      SELECT file_name, greatest(k % 8, CASE WHEN k % 5 = 0 THEN (k + 3) % 8 ELSE 0 END) + 1 AS folder_pos,
        CASE WHEN {EMPTY_SQL} THEN 'GB-Filings/Problematic' ELSE 'GB-Filings' END AS queue
      FROM placed WHERE coalesce(pou, '') <> '' AND gb > 0 AND place >= gb""",
)
def gb_preparation(spark, sf_dir):
    """Loading-port folders to GB queues: the filing rule, the last folder of a file, the rewrite, the queues.

    A stored file holds many documents, so the file name of each is taken from its reference.
    """
    root, out = shared_dir(spark, "gb"), shared_dir(spark, "gb-queues")
    docs = decl.documents(spark, sf_dir)
    k = F.col("doc")
    for i, folder in enumerate(GB_FOLDERS):
        here = (k % 8 == i) | ((k % 5 == 0) & ((k + 3) % 8 == i))
        sinks.write_declaration_files(docs.filter(here), f"{root}/{folder}")
    found, _ = source.split_corrupt(source.read_gb_candidates(spark, root.removeprefix("file://")))
    d = F.col(DECL)
    named = found.withColumn("file_name", F.concat(F.regexp_replace(d["LocalReferenceNumber"], "^LRN", "D"), F.lit(".xml")))
    prepared = headers.prepare_gb(
        named.withColumn("folder_pos", F.col("folder_pos").cast("long")),
        vessel_routes(spark),
        imo=F.lit("9242558"),
        voyage=F.lit("V001E"),
        arrival_day=F.lit("20240815"),
        gb_tin=GB_TIN,
    )
    sinks.write_queues(prepared, out)
    return spark.read.parquet(out).select("file_name", "folder_pos", F.col("queue").cast("string").alias("queue"))
