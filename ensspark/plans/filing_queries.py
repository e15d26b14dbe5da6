"""Header updates, GB filings and F10 conversion over derived declarations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark import sinks
from ensspark.operators import f10, headers, routing
from ensspark.operators.headers import DECL
from ensspark.plans import declarations as decl
from ensspark.plans.declarations import DOCS_SQL, FLAT_SQL, OFFICES_SQL, ROUTES_SQL
from ensspark.plans.document_queries import REPAIR_SQL
from ensspark.plans.registry import query
from ensspark.plans.standin import PORTS, pick, sql_list, table
from ensspark.schemas import CORRUPT, GB_FOLDERS, IMO_FLAGS
from ensspark.session import land
from ensspark.sources import declarations as source
from ensspark.sources.lookups import imo_flags, port_offices, vessel_routes

GB_TIN, OTHER_TIN = "GB999", "XI999"
ISSUED = dt.datetime(2025, 12, 1, 9, 30)
NEW_PORTS = [*PORTS, "gbliv", "GBFXT", "ESVLC"]

# --- header updates -------------------------------------------------------------------------------

ARRIVAL_SQL = "CASE WHEN k % 17 = 0 THEN '01.02.1999' ELSE strftime(arrival_date, '%Y-%m-%d') END"
UPDATE_SQL = f"""{DOCS_SQL}, {OFFICES_SQL}, asked AS (
  SELECT docs.*, {ARRIVAL_SQL} AS wanted, k % 17 = 0 AS bad, {sql_list(NEW_PORTS)}[k % {len(NEW_PORTS)} + 1] AS port_new FROM docs),
updated AS (
  SELECT a.k AS doc, CASE WHEN bad THEN 'Invalid date format: ' || wanted END AS error,
    CASE WHEN bad THEN voyage ELSE 'NV' || k END AS voyage, CASE WHEN bad THEN imo ELSE '1016563' END AS imo,
    CASE WHEN bad THEN decl_place ELSE port_new END AS decl_place,
    CASE WHEN bad THEN office ELSE coalesce(o.ref_num, office) END AS office,
    CASE WHEN bad THEN arrival ELSE strftime(arrival_date, '%Y%m%d') || '0000' END AS arrival,
    CASE WHEN has_consignor THEN CASE WHEN bad THEN consignor_number ELSE coalesce(consignor_number, 'N/A') END END AS consignor_number,
    CASE WHEN has_consignee THEN CASE WHEN bad THEN consignee_number ELSE coalesce(consignee_number, 'N/A') END END AS consignee_number,
    CASE WHEN bad OR lodging_tin IS NULL THEN lodging_tin WHEN upper(port_new) IN ('GBLIV', 'GBFXT') THEN 'GB999' ELSE 'XI999' END AS lodging_tin,
    CASE WHEN bad THEN carrier_tin WHEN upper(port_new) IN ('GBLIV', 'GBFXT') THEN 'GB999' ELSE 'XI999' END AS carrier_tin,
    NOT bad AS changed
  FROM asked a LEFT JOIN office_of o ON o.port = upper(a.port_new))"""


def update_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decl.documents(spark, sf_dir)
    k = F.col("doc")
    day = F.to_date(F.substring(F.col(DECL)["DeclDateTime"], 1, 8), "yyyyMMdd")
    asked = docs.withColumns(
        {
            "wanted": F.when(k % 17 == 0, "01.02.1999").otherwise(F.date_format(F.date_add(day, 10), "yyyy-MM-dd")),
            "port_new": pick(NEW_PORTS, k % len(NEW_PORTS)),
        }
    )
    asked = routing.office_lookup(asked, port_offices(spark), "port_new")
    return headers.update_headers(
        asked,
        voyage=decl.join("NV", k),
        imo=F.lit("1016563"),
        port=F.col("port_new"),
        arrival=F.col("wanted"),
        ref_num=F.col("ref_num"),
        gb_tin=GB_TIN,
        other_tin=OTHER_TIN,
    )


def _header_columns() -> list[Column]:
    d = F.col(DECL)
    return [
        d["ConveyanceRefNum"].alias("voyage"),
        d["IdeOfMeaOfTraCro"].alias("imo"),
        d["DeclPlace"].alias("decl_place"),
        d["CustOfficeOfFirstEntry"]["RefNum"].alias("office"),
        d["CustOfficeOfFirstEntry"]["ExpectedDateTimeOfArrival"].alias("arrival"),
        d["Consignor"]["Number"].alias("consignor_number"),
        d["Consignee"]["Number"].alias("consignee_number"),
        d["LodgingPerson"]["TIN"].alias("lodging_tin"),
        d["Carrier"]["TIN"].alias("carrier_tin"),
    ]


@query("header_update", f"WITH {UPDATE_SQL} SELECT * FROM updated")
def header_update(spark, sf_dir):
    return update_documents(spark, sf_dir).select("doc", "error", "changed", *_header_columns())


@query(
    "batch_summary",
    f"""WITH {UPDATE_SQL} SELECT count(*) AS documents, count(*) FILTER (changed) AS changed_documents,
      count(error) AS errors FROM updated""",
)
def batch_summary(spark, sf_dir):
    return headers.batch_summary(update_documents(spark, sf_dir))


@query(
    "header_batch",
    f"""WITH {DOCS_SQL}, verdicts AS (SELECT k, bool_and(coalesce(length(regexp_replace(coalesce(tariff, harmonized), '[^0-9]', '', 'g')) = 6, FALSE)) AS ok,
        bool_or(tariff IS NULL AND harmonized IS NULL) AS missing FROM goods GROUP BY k)
      SELECT d.k AS doc, coalesce(v.ok, FALSE) AS tariff_valid, CASE WHEN d.k % 3 = 0 THEN voyage ELSE 'B' || d.k END AS voyage,
        '9212010' AS imo, decl_place, 'IT084100' AS office, '199901010000' AS arrival,
        CASE WHEN has_consignor THEN coalesce(consignor_number, 'N/A') END AS consignor_number,
        CASE WHEN has_consignee THEN coalesce(consignee_number, 'N/A') END AS consignee_number, lodging_tin, carrier_tin,
        TRUE AS changed
      FROM docs d LEFT JOIN verdicts v ON v.k = d.k""",
)
def header_batch(spark, sf_dir):
    values = {
        "IdeOfMeaOfTraCro": F.lit("9212010"),
        "ConveyanceRefNum": F.when(F.col("doc") % 3 == 0, " ").otherwise(decl.join("B", F.col("doc"))),
        "DeclPlace": F.lower(F.col(DECL)["DeclPlace"]),
        "RefNum": F.lit("IT084100"),
        "ExpectedDateTimeOfArrival": F.lit("199901010000"),
    }
    updated = headers.batch_update(decl.documents(spark, sf_dir), values)
    return updated.select("doc", "tariff_valid", "changed", *_header_columns())


# --- GB filings -----------------------------------------------------------------------------------

EMPTY_SQL = """(coalesce(pou = '', FALSE) OR coalesce(trim(commercial_ref) = '', FALSE)
  OR (has_consignor AND (trim(consignor_city) = '' OR coalesce(consignor_number = '', FALSE)))
  OR k % 6 = 0 OR k % 5 = 0 OR k IN (SELECT k FROM goods WHERE tariff = ''))"""


def _gb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.gb_rewrite(
        decl.documents(spark, sf_dir),
        imo=F.lit("9242558"),
        voyage=F.lit("V001E"),
        arrival_day=F.lit("20240815"),
        gb_tin=GB_TIN,
    )


@query(
    "gb_rewrite",
    f"""WITH {DOCS_SQL}, numbers AS (SELECT k, string_agg(CASE WHEN item_number IS NOT NULL THEN CAST(i AS VARCHAR) END, ',' ORDER BY i) AS item_numbers,
        count(item_number) AS n FROM goods GROUP BY k)
      SELECT d.k AS doc, 'V001E' AS voyage, '9242558' AS imo, 'GBLIV' AS decl_place, 'GB000080' AS office, '202408150000' AS arrival,
        CASE WHEN has_consignor THEN consignor_number END AS consignor_number,
        CASE WHEN has_consignee THEN consignee_number END AS consignee_number,
        CASE WHEN lodging_tin IS NOT NULL THEN 'GB999' END AS lodging_tin, 'GB999' AS carrier_tin,
        CASE WHEN total_items IS NOT NULL THEN CAST(coalesce(n, 0) AS VARCHAR) END AS total_items,
        coalesce(item_numbers, '') AS item_numbers,
        CASE WHEN has_consignor THEN regexp_replace(consignor_name, '[&#$%*]', '', 'g') END AS consignor_name,
        CASE WHEN has_consignor THEN regexp_replace(consignor_address, '[&#$%*]', '', 'g') END AS consignor_address,
        CASE WHEN {EMPTY_SQL.replace('k ', 'd.k ').replace('(SELECT d.k ', '(SELECT k ')} THEN 'GB-Filings/Problematic' ELSE 'GB-Filings' END AS queue
      FROM docs d LEFT JOIN numbers m ON m.k = d.k""",
)
def gb_rewrite(spark, sf_dir):
    d = F.col(DECL)
    return _gb(spark, sf_dir).select(
        "doc",
        *_header_columns(),
        d["TotalNumberOfItems"].alias("total_items"),
        F.array_join(F.coalesce(d["GoodsItem"]["ItemNumber"], F.array().cast("array<string>")), ",").alias("item_numbers"),
        d["Consignor"]["Name"].alias("consignor_name"),
        d["Consignor"]["Address"].alias("consignor_address"),
        "queue",
    )


@query(
    "gb_queues",
    f"""WITH {DOCS_SQL} SELECT CASE WHEN {EMPTY_SQL} THEN 'GB-Filings/Problematic' ELSE 'GB-Filings' END AS queue,
      count(*) AS documents FROM docs GROUP BY 1""",
)
def gb_queues(spark, sf_dir):
    return headers.queue_counts(_gb(spark, sf_dir))


@query("empty_tags", f"WITH {DOCS_SQL} SELECT k AS doc, {EMPTY_SQL} AS typed, {EMPTY_SQL} AS raw FROM docs")
def empty_tags(spark, sf_dir):
    """Empty tags by the typed rule, and by the generic one over the written document."""
    docs = decl.documents(spark, sf_dir)
    written = docs.withColumn("xml", sinks.declaration_xml(F.col("Interchange"), F.col(DECL)))
    marked = written.withColumn(CORRUPT, F.when(F.col("xml").isNull(), "missing"))
    return marked.select(
        "doc", headers.empty_tag().alias("typed"), headers.empty_tag_in_text(F.col("xml"), F.col(CORRUPT)).alias("raw")
    )


@query(
    "latest_file_wins",
    f"""WITH files AS (SELECT 'F' || l_partkey || '.xml' AS file_name, l_suppkey % 8 AS folder_pos, max(l_orderkey) AS doc
        FROM lineitem GROUP BY ALL)
      SELECT file_name, CAST(max(folder_pos) AS BIGINT) AS folder_pos, arg_max(doc, folder_pos) AS doc,
        {sql_list(GB_FOLDERS)}[max(folder_pos) + 1] AS folder FROM files GROUP BY file_name""",
)
def latest_file_wins(spark, sf_dir):
    place = F.col("l_suppkey") % 8
    files = (
        table(spark, sf_dir, "lineitem")
        .groupBy(decl.join("F", F.col("l_partkey"), ".xml").alias("file_name"), place.alias("folder_pos"))
        .agg(F.max("l_orderkey").alias("doc"))
        .withColumn("folder", pick(GB_FOLDERS, F.col("folder_pos")))
    )
    return headers.latest_by_file_name(files, "folder_pos")


# --- F10 conversion ---------------------------------------------------------------------------------


def _plain_sql(value: str) -> str:
    for garbled, letter in (
        ("Ãœ", "U"), ("Ã¼", "u"), ("Ä°", "I"), ("Ä±", "i"), ("Åž", "S"), ("ÅŸ", "s"),
        ("Ã‡", "C"), ("Ã§", "c"), ("Ã–", "O"), ("Ã¶", "o"), ("Äž", "G"), ("ÄŸ", "g"),
    ):
        value = f"replace({value}, '{garbled}', '{letter}')"
    return f"strip_accents({value})"


def _clean_sql(value: str) -> str:
    normal = f"replace(replace(replace({value}, '&;', ' and '), '''', ''), '&', ' and ')"
    normal = f"regexp_replace({normal}, '[\\s]{{2,}}', ' ', 'g')"
    return f"regexp_replace({_plain_sql(normal)}, '[^a-zA-Z0-9 /.,''&()-]', '', 'g')"


F10_SQL = f"""{REPAIR_SQL.replace("l.offices", "list_filter(l.offices, lambda x: x <> 'GB000080') AS offices")},
flags(imo, flag) AS (VALUES {", ".join(f"('{i}', '{f}')" for i, f in IMO_FLAGS.items())}),
hs_codes AS (SELECT upper(p_name) AS description, CASE WHEN max(p_partkey) % 3 = 0 THEN '12345'
    ELSE lpad(CAST(max(p_partkey) % 1000000 AS VARCHAR), 6, '0') END AS code FROM part GROUP BY p_name),
box_types AS (SELECT 'MCLU' || lpad(CAST(p_partkey * 10 + 4 AS VARCHAR), 7, '0') AS container,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2' || (p_partkey % 10) END AS size_type FROM part),
items AS (
  SELECT g.*, {_clean_sql('g.description')} AS clean_description,
    coalesce(g.harmonized, g.tariff, h.code) AS hs
  FROM goods g LEFT JOIN hs_codes h ON h.description = upper({_clean_sql('g.description')})),
bad AS (SELECT k FROM items WHERE coalesce(length(hs), 0) <> 6),
judged AS (
  SELECT f.*, flags.flag, CASE WHEN f.k IN (SELECT k FROM bad) THEN 'Failed HS Code Check'
    WHEN arrival = 'unknown' THEN 'Invalid ExpectedDateTimeOfArrival' END AS reject_reason
  FROM flagged f LEFT JOIN flags ON flags.imo = f.imo),
converted AS (SELECT * FROM judged WHERE reject_reason IS NULL)"""


def lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Container types and HS codes derived from parts."""
    part = table(spark, sf_dir, "part")
    top, key = F.max("p_partkey"), F.col("p_partkey")
    hs_codes = part.groupBy(F.col("p_name").alias("description")).agg(
        F.when(top % 3 == 0, "12345").otherwise(F.lpad((top % 1000000).cast("string"), 6, "0")).alias("code")
    )
    types = part.select(
        decl.join("mclu", decl.digits(key * 10 + 4, 7)).alias("container"),
        F.when(key % 3 == 0, "").otherwise(decl.join("2", key % 10)).alias("size_type"),
    )
    return types, hs_codes


def filings(spark: SparkSession, sf_dir: str, rejects: bool = True) -> DataFrame:
    """All documents, converted or refused; without ``rejects`` the converted ones."""
    types, hs_codes = lookups(spark, sf_dir)
    # The conversion reads its documents once per lookup: land them, as after parsing XML.
    return f10.convert(
        land(decl.documents(spark, sf_dir), "declarations"),
        routes=vessel_routes(spark),
        flags=imo_flags(spark),
        issued=F.lit(ISSUED).cast("timestamp_ntz"),
        container_types=types,
        hs_codes=hs_codes,
        rejects=rejects,
    )


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir, rejects=False).select("doc", "f10_name", "F10")


BODY = "F10.SMFENS2FilingBody"
MEANS = f"{BODY}.ActiveBorderTransportMeans"
MASTER = f"{BODY}.ConsignmentMasterLevel"
HOUSE = f"{MASTER}.ConsignmentHouseLevel"


@query(
    "f10_header",
    f"""WITH {F10_SQL} SELECT k AS doc, lrn || '_F10' AS f10_name, lrn, '2025-12-01T09:30:00Z' AS issued, 'IMO' || imo AS identification,
        coalesce(flag, '') AS nationality, strftime(decl_date - 3, '%Y-%m-%dT00:00:00Z') AS departure,
        strftime(arrival_date, '%Y-%m-%dT06:30:00Z') AS arrival, gross, decl_place AS acceptance, coalesce(pol, '') AS loading,
        coalesce(pou, '') AS unloading, coalesce(pou, '') AS delivery, 'H' AS charges,
        CASE WHEN k % 13 = 1 THEN ' ' ELSE coalesce(commercial_ref, '') END AS document_number,
        CASE WHEN n_items = 0 THEN '' WHEN k % 2 = 0 THEN 'N705' ELSE 'N703' END AS document_type, office AS first_office
      FROM converted""",
)
def f10_header(spark, sf_dir):
    return _accepted(spark, sf_dir).select(
        "doc",
        "f10_name",
        F.col(f"{BODY}.LRN").alias("lrn"),
        F.col(f"{BODY}.documentIssueDate").alias("issued"),
        F.col(f"{MEANS}.identificationNumber").alias("identification"),
        F.col(f"{MEANS}.nationality").alias("nationality"),
        F.col(f"{MEANS}.estimatedDateAndTimeOfDeparture").alias("departure"),
        F.col(f"{MEANS}.estimatedDateAndTimeOfArrival").alias("arrival"),
        F.col(f"{HOUSE}.totalGrossMass").alias("gross"),
        F.col(f"{HOUSE}.PlaceOfAcceptance.unlocode").alias("acceptance"),
        F.col(f"{MASTER}.PlaceOfLoading.unlocode").alias("loading"),
        F.col(f"{MASTER}.PlaceOfUnloading.unlocode").alias("unloading"),
        F.col(f"{HOUSE}.PlaceOfDelivery.unlocode").alias("delivery"),
        F.col(f"{HOUSE}.TransportCharges.methodOfPayment").alias("charges"),
        F.col(f"{MASTER}.TransportDocumentMasterLevel.documentNumber").alias("document_number"),
        F.col(f"{MASTER}.TransportDocumentMasterLevel.type").alias("document_type"),
        F.col(f"{BODY}.CustomsOfficeOfFirstEntry.referenceNumber").alias("first_office"),
    )


@query(
    "f10_routing",
    f"""WITH {F10_SQL}, steps AS (SELECT k, CASE WHEN it_changed THEN right_itinerary ELSE itinerary END AS it FROM converted)
      SELECT k AS doc, CAST(n AS VARCHAR) AS sequence_number, it[n] AS country FROM (SELECT k, it, unnest(range(1, len(it) + 1)) AS n FROM steps)""",
)
def f10_routing(spark, sf_dir):
    steps = _accepted(spark, sf_dir).select("doc", F.explode(f"{MEANS}.CountriesOfRoutingOfMeansOfTransport").alias("s"))
    return steps.select("doc", F.col("s.sequenceNumber").alias("sequence_number"), F.col("s.country").alias("country"))


@query(
    "f10_offices",
    f"""WITH {F10_SQL}, steps AS (SELECT k, CASE WHEN of_changed THEN right_offices ELSE offices END AS codes FROM converted)
      SELECT k AS doc, CAST(n AS INTEGER) AS pos, codes[n] AS office FROM (SELECT k, codes, unnest(range(1, len(codes) + 1)) AS n FROM steps)""",
)
def f10_offices(spark, sf_dir):
    steps = _accepted(spark, sf_dir).select("doc", F.posexplode(f"{BODY}.CustOfficeOfSubsequentEntry").alias("pos", "o"))
    return steps.select("doc", (F.col("pos") + 1).alias("pos"), F.col("o.RefNum").alias("office"))


@query(
    "f10_goods",
    f"""WITH {F10_SQL} SELECT i.k AS doc, CAST(i AS VARCHAR) AS item, clean_description AS description, hs,
        coalesce(un_number, '') AS un_number, i.gross, marks, i.packages, 'CY' AS kind
      FROM items i JOIN converted c ON c.k = i.k""",
)
def f10_goods(spark, sf_dir):
    items = _accepted(spark, sf_dir).select("doc", F.explode(f"{HOUSE}.GoodsItem").alias("g"))
    return items.select(
        "doc",
        F.col("g.goodsItemNumber").alias("item"),
        F.col("g.Commodity.descriptionOfGoods").alias("description"),
        F.col("g.Commodity.CommodityCode.harmonizedSystemSubHeadingCode").alias("hs"),
        F.col("g.Commodity.DangerousGoods.unNumber").alias("un_number"),
        F.col("g.Weight.grossMass").alias("gross"),
        F.col("g.Packaging.shippingMarks").alias("marks"),
        F.col("g.Packaging.numberOfPackages").alias("packages"),
        F.col("g.Packaging.typeOfPackages").alias("kind"),
    )


@query(
    "f10_equipment",
    f"""WITH {F10_SQL} SELECT b.k AS doc, CAST(b.i AS VARCHAR) AS item, b.container,
        coalesce(nullif(t.size_type, ''), '18') AS size_type, 'B' AS status, '2' AS supplier,
        CASE WHEN s.seal IS NULL THEN '0' ELSE '1' END AS seals, coalesce(s.seal, 'None') AS seal
      FROM boxes b JOIN converted c ON c.k = b.k LEFT JOIN box_types t ON t.container = b.container
      LEFT JOIN seals s ON s.k = b.k AND s.container = b.container""",
)
def f10_equipment(spark, sf_dir):
    items = _accepted(spark, sf_dir).select("doc", F.explode(f"{HOUSE}.GoodsItem").alias("g"))
    boxes = items.select("doc", F.col("g.goodsItemNumber").alias("item"), F.explode("g.TransportEquipment").alias("b"))
    return boxes.select(
        "doc",
        "item",
        F.col("b.containerIdentificationNumber").alias("container"),
        F.col("b.containerSizeAndType").alias("size_type"),
        F.col("b.containerPackedStatus").alias("status"),
        F.col("b.containerSupplierType").alias("supplier"),
        F.col("b.numberOfSeals").alias("seals"),
        F.col("b.Seal.identifier").alias("seal"),
    )


CONSIGNEE_NAME = _clean_sql("consignee_name")
PARTIES_SQL = f"""SELECT k AS doc, role, {_clean_sql('consignee_name')} AS name, 'Marseille' AS city, 'FR' AS country,
    {_clean_sql('consignee_address')} AS street, '13002' AS post_code, coalesce(consignee_number, 'N/A') AS number
  FROM converted, (VALUES ('Consignee'), ('Buyer')) r(role)
  UNION ALL SELECT k, role, CASE WHEN has_consignor THEN {_clean_sql('consignor_name')} ELSE '' END,
    CASE WHEN has_consignor THEN {_clean_sql('consignor_city')} ELSE '' END, CASE WHEN has_consignor THEN 'ES' ELSE '' END,
    CASE WHEN has_consignor THEN {_clean_sql('consignor_address')} ELSE '' END,
    CASE WHEN has_consignor THEN consignor_zip ELSE '' END,
    CASE WHEN has_consignor THEN coalesce(nullif(consignor_number, ''), 'N/A') ELSE '' END
  FROM converted, (VALUES ('Consignor'), ('Seller')) r(role)"""


@query("f10_parties", f"WITH {F10_SQL} {PARTIES_SQL}")
def f10_parties(spark, sf_dir):
    house = F.col(HOUSE)
    roles = F.array(
        F.struct(F.lit("Consignee").alias("role"), house["Consignee"].alias("p")),
        F.struct(F.lit("Consignor").alias("role"), house["Consignor"].alias("p")),
        F.struct(F.lit("Buyer").alias("role"), house["GoodsShipment"]["Buyer"].alias("p")),
        F.struct(F.lit("Seller").alias("role"), house["GoodsShipment"]["Seller"].alias("p")),
    )
    rows = _accepted(spark, sf_dir).select("doc", F.explode(roles).alias("r"))
    address = F.col("r.p.Address")
    return rows.select(
        "doc",
        F.col("r.role").alias("role"),
        F.col("r.p.name").alias("name"),
        address["city"].alias("city"),
        address["country"].alias("country"),
        address["street"].alias("street"),
        address["postCode"].alias("post_code"),
        address["number"].alias("number"),
    )


@query(
    "f10_rejects",
    f"WITH {F10_SQL} SELECT k AS doc, reject_reason FROM judged WHERE reject_reason IS NOT NULL",
)
def f10_rejects(spark, sf_dir):
    return filings(spark, sf_dir).filter(F.col("reject_reason").isNotNull()).select("doc", "reject_reason")


@query(
    "conversion_queues",
    f"""WITH {F10_SQL} SELECT CASE WHEN reject_reason IS NULL THEN 'Upload' WHEN reject_reason = 'Failed HS Code Check'
      THEN 'HSCode_Failed' ELSE 'Failed' END AS queue, count(*) AS documents FROM judged GROUP BY 1""",
)
def conversion_queues(spark, sf_dir):
    return headers.queue_counts(filings(spark, sf_dir).withColumn("queue", sinks.conversion_queue()))


@query(
    "flatten_goods",
    f"""WITH {DOCS_SQL} SELECT d.k AS doc, CAST(g.i AS INTEGER) AS item_pos, g.description, coalesce(g.tariff, g.harmonized) AS code,
        CAST(g.gross AS DOUBLE) AS gross_weight, CAST(b.j AS INTEGER) AS container_pos, b.container, s.seal
      FROM docs d LEFT JOIN goods g ON g.k = d.k LEFT JOIN boxes b ON b.k = g.k AND b.i = g.i
      LEFT JOIN seals s ON s.k = b.k AND s.container = b.container""",
)
def flatten_goods(spark, sf_dir):
    rows = f10.flatten_goods(decl.documents(spark, sf_dir))
    return rows.withColumn("gross_weight", F.col("gross_weight").cast("double"))


@query(
    "document_counts",
    f"""WITH {DOCS_SQL} SELECT d.k AS doc, CAST(n_items AS INTEGER) AS items,
        CAST((SELECT count(*) FROM boxes b WHERE b.k = d.k) AS INTEGER) AS containers,
        CAST(len(itinerary) AS INTEGER) AS itinerary_rows, CAST(len(offices) AS INTEGER) AS subsequent_offices
      FROM docs d JOIN lists l ON l.k = d.k""",
)
def document_counts(spark, sf_dir):
    return f10.item_counts(decl.documents(spark, sf_dir))


# --- flat rows ----------------------------------------------------------------------------------------


@query(
    "item_sequence",
    f"""WITH {FLAT_SQL} SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY pos) AS sequence_number FROM flat_items""",
)
def item_sequence(spark, sf_dir):
    items = decl.goods_items(spark, sf_dir).select("doc", "pos")
    return f10.number_items(items)


@query(
    "first_seals",
    f"""WITH {FLAT_SQL} SELECT doc, container, arg_min(seal, pos) AS seal FROM flat_seals
      WHERE seal <> '' AND container IS NOT NULL GROUP BY doc, container""",
)
def first_seals(spark, sf_dir):
    return f10.first_seals(decl.seals(spark, sf_dir))


@query(
    "container_equipment",
    f"""WITH {FLAT_SQL}, sealed AS (SELECT doc, container, arg_min(seal, pos) AS seal FROM flat_seals
        WHERE seal <> '' AND container IS NOT NULL GROUP BY doc, container)
      SELECT c.doc, c.pos, c.container, coalesce(nullif(t.size_type, ''), '18') AS size_type,
        coalesce(s.seal, 'None') AS seal, CASE WHEN s.seal IS NULL THEN 0 ELSE 1 END AS seals
      FROM flat_containers c LEFT JOIN sealed s ON s.doc = c.doc AND s.container = c.container
      LEFT JOIN types t ON t.container = c.container""",
)
def container_equipment(spark, sf_dir):
    return f10.equipment(
        decl.containers(spark, sf_dir), decl.seals(spark, sf_dir), decl.container_types(spark, sf_dir)
    )


@query(
    "hs_resolve",
    f"""WITH {FLAT_SQL}, codes AS (SELECT p_name, lpad(CAST(max(p_partkey) % 100000 AS VARCHAR), 5 + CAST(max(p_partkey) % 2 AS INTEGER), '0') AS code
        FROM part GROUP BY p_name)
      SELECT doc, pos, description, coalesce(harmonized, tariff, code) AS hs, coalesce(length(coalesce(harmonized, tariff, code)) = 6, FALSE) AS hs_ok
      FROM flat_items LEFT JOIN codes ON p_name = description""",
)
def hs_resolve(spark, sf_dir):
    top = F.max("p_partkey")
    width = (F.lit(5) + top % 2).cast("int")
    codes = table(spark, sf_dir, "part").groupBy(F.initcap("p_name").alias("description")).agg(
        F.lpad((top % 100000).cast("string"), width, F.lit("0")).alias("code")
    )
    resolved = f10.resolve_hs(decl.goods_items(spark, sf_dir), codes)
    return resolved.select("doc", "pos", "description", "hs", "hs_ok")


# --- documents as text -----------------------------------------------------------------------------------


@query(
    "xml_roundtrip",
    f"""WITH {DOCS_SQL} SELECT d.k AS doc, lrn, imo, pou, commercial_ref, CASE WHEN has_consignor THEN consignor_name END AS consignor_name,
        array_to_string(itinerary, '|') AS itinerary, array_to_string(offices, '|') AS offices, CAST(n_items AS INTEGER) AS items,
        coalesce((SELECT string_agg(coalesce(tariff, '-'), '|' ORDER BY i) FROM goods g WHERE g.k = d.k), '') AS tariffs
      FROM docs d JOIN lists l ON l.k = d.k""",
)
def xml_roundtrip(spark, sf_dir):
    """Write every declaration as XML text, parse it back, and compare the values."""
    docs = decl.documents(spark, sf_dir)
    written = docs.select("doc", sinks.declaration_xml(F.col("Interchange"), F.col(DECL)).alias("xml"))
    parsed = source.parse_declarations(written)
    d = F.col(DECL)
    none = F.array().cast("array<string>")
    tariffs = F.transform(d["GoodsItem"]["TariffNumber"], lambda t: F.coalesce(t, F.lit("-")))
    return parsed.select(
        "doc",
        d["LocalReferenceNumber"].alias("lrn"),
        d["IdeOfMeaOfTraCro"].alias("imo"),
        d["PlaceOfUnloading"].alias("pou"),
        d["CommercialRefNum"].alias("commercial_ref"),
        d["Consignor"]["Name"].alias("consignor_name"),
        F.array_join(F.coalesce(d["Itinerary"]["CountryCode"], none), "|").alias("itinerary"),
        F.array_join(F.coalesce(d["CustOfficeOfSubsequentEntry"]["RefNum"], none), "|").alias("offices"),
        F.coalesce(F.size(d["GoodsItem"]), F.lit(0)).alias("items"),
        F.array_join(F.coalesce(tariffs, none), "|").alias("tariffs"),
    )


@query(
    "f10_roundtrip",
    f"""WITH {F10_SQL} SELECT k AS doc, lrn, 'F10' AS kind, CAST(n_items AS INTEGER) AS items, {CONSIGNEE_NAME} AS consignee FROM converted""",
)
def f10_roundtrip(spark, sf_dir):
    """Write every filing, detect its kind from the text, parse it back."""
    written = _accepted(spark, sf_dir).select("doc", sinks.f10_xml(F.col("F10")).alias("xml"))
    parsed = source.parse_filings(source.with_kind(written, keep="parsed"), parsed="parsed")
    return parsed.select(
        "doc",
        F.col(f"{BODY}.LRN").alias("lrn"),
        "kind",
        F.coalesce(F.size(f"{HOUSE}.GoodsItem"), F.lit(0)).alias("items"),
        F.col(f"{HOUSE}.Consignee.name").alias("consignee"),
    )
