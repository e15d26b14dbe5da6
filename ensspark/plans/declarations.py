"""Declarations derived from orders (nested) and goods items derived from lineitem (flat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.functions.values import literal_list
from ensspark.plans.standin import IMOS, PORTS, pick, sql_list, table
from ensspark.schemas import PORT_OFFICES, ROUTE_PORTS

ROUTED = sorted({port for ports in ROUTE_PORTS.values() for port in ports})
OFFICES = list(PORT_OFFICES.values())
ADJECTIVES = ["small", "blue", "new", "cold", "hot", "old", "red", "large"]
NOUNS = ["ring", "bolt", "gear", "gizmo", "widget", "anvil", "plate", "rod"]


def text(value: Column) -> Column:
    return value.cast("string")


def join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])


def digits(value: Column, width: int) -> Column:
    return F.lpad(text(value), width, "0")


def upto(limit: Column, most: int) -> Column:
    """1..limit as an array, limit at most ``most``."""
    return F.filter(F.array(*[F.lit(i) for i in range(1, most + 1)]), lambda i: i <= limit)


def _item(k: Column, i: Column) -> Column:
    kind = (k + i) % 7
    description = join(pick(ADJECTIVES, (k + i) % 8), " ", pick(NOUNS, (k * 3 + i) % 8))
    containers = F.transform(
        upto((k + i) % 3, 2),
        lambda j: F.struct(
            join("MCLU", digits((k * 10 + i * 3 + j) % 10000000, 7)).alias("ContainerNumber"),
            text(j).alias("PackageQuantity"),
        ),
    )
    return F.struct(
        F.when(k % 4 != 0, text(i * 10)).alias("ItemNumber"),
        F.when((k + i) % 5 == 0, join(description, " #é")).otherwise(description).alias("Description"),
        F.when(kind == 1, "70191")
        .when(kind == 2, "7019.12")
        .when(kind == 3, "")
        .when(kind > 3, digits((k * 613 + i) % 1000000, 6))
        .alias("TariffNumber"),
        F.when((k * i) % 5 == 0, digits((k * 7 + i) % 1000000, 6)).alias("harmonizedSystemSubHeadingCode"),
        text(k % 1000 + i).alias("GrossWeight"),
        F.when((k + i) % 4 == 0, "1263").alias("UnDangerousGoodsCode"),
        F.when(F.size(containers) > 0, containers).alias("Container"),
        F.struct(
            join("MK", i).alias("Marks"), F.lit("CY").alias("KindOfPackage"), text(k % 20 + 1).alias("NumberOfPackages")
        ).alias("Package"),
        F.struct(
            F.when(k % 2 == 0, "N705").otherwise("N703").alias("DocumentType"), join("LRN", k).alias("DocumentReference")
        ).alias("ProducedDocument"),
    )


def _party(name: Column, address: Column, country: str, zip_code: Column, city: Column, number: Column) -> Column:
    return F.struct(
        name.alias("Name"),
        address.alias("Address"),
        F.lit(country).alias("Country"),
        zip_code.alias("ZipCode"),
        city.alias("City"),
        number.alias("Number"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration per order: ``file_name``, ``folder`` and the two nested document parts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pol = F.when(k % 43 != 0, pick(ROUTED, k % len(ROUTED)))
    pou = (
        F.when(k % 29 == 0, F.lit(None).cast("string"))
        .when(k % 23 == 0, "GBBEL")
        .when(k % 37 == 0, "")
        .otherwise(pick(ROUTED, (F.floor(k / 18) + k * 5) % len(ROUTED)))
    )
    countries = (
        F.when(k % 3 == 0, F.array(F.substring(F.coalesce(pol, F.lit("ZZ")), 1, 2), F.substring(F.coalesce(pou, F.lit("ZZ")), 1, 2)))
        .when(k % 3 == 1, literal_list(["EG", "TR", "IT", "FR", "ES"]))
        .otherwise(literal_list([" IL ", "CY"]))
    )
    offices = (
        F.when(k % 4 == 1, literal_list(["GB000080", "FR002730"]))
        .when(k % 4 == 2, literal_list(["FR002730", "ES000811"]))
        .when(k % 4 == 3, literal_list(["IEDUB100"]))
    )
    arrival = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), "yyyyMMdd")
    consignor = _party(
        join("O'Brien & Söhne #", c),
        join("Calle Ñandú ", k, " 100%"),
        "ES",
        digits(k % 1000, 5),
        F.when(k % 9 == 0, "").when(k % 9 == 1, " ").otherwise("Málaga"),
        F.when(k % 6 == 1, "").when(k % 6 > 1, text(k % 90)),
    )

    def receiver(name: str) -> Column:
        return _party(
            join(name, c),
            join("Rue de l'Église; ", k),
            "FR",
            F.lit("13002"),
            F.lit("Marseille"),
            F.when(k % 4 != 0, "7"),
        )

    first_container = join("MCLU", digits((k * 10 + 4) % 10000000, 7))
    seal_id = [
        F.when(k % 6 == 0, "").otherwise(join("S", digits(k * 3 + 1, 8))),
        F.when(k % 5 == 0, "").otherwise(join("S", digits(k * 3 + 2, 8))),
        join("S", digits(k * 3 + 3, 8)),
    ]
    seals = F.array(
        F.struct(seal_id[0].alias("SealID"), first_container.alias("ContainerNumber")),
        F.struct(seal_id[1].alias("SealID"), first_container.alias("ContainerNumber")),
        F.struct(seal_id[2].alias("SealID"), F.lit(None).cast("string").alias("ContainerNumber")),
    )
    declaration = F.struct(
        join("LRN", k).alias("LocalReferenceNumber"),
        F.when(k % 6 != 0, "9").alias("TotalNumberOfItems"),
        text(k % 20 + 1).alias("TotalNumberOfPackages"),
        F.when(k % 13 == 1, "  ").when(k % 13 > 1, join("CR", F.floor(k / 2))).alias("CommercialRefNum"),
        F.lit("1").alias("TransportModeAtBorder"),
        pick(IMOS, c % len(IMOS)).alias("IdeOfMeaOfTraCro"),
        join("V", k % 500).alias("ConveyanceRefNum"),
        pol.alias("PlaceOfLoading"),
        pou.alias("PlaceOfUnloading"),
        text(k % 5000 + 100).alias("TotalGrossWeight"),
        F.lit("H").alias("TransportChargesMethodOfPayment"),
        join(F.date_format("o_orderdate", "yyyyMMdd"), "0000").alias("DeclDateTime"),
        pick(PORTS, k % len(PORTS)).alias("DeclPlace"),
        F.when(k % 47 != 0, consignor).alias("Consignor"),
        F.when(k % 10 != 0, receiver("Ä°STANBUL Gıda ")).alias("Consignee"),
        F.when(k % 10 == 0, receiver("Notify ")).alias("NotifyParty"),
        F.when(k % 53 != 0, F.struct(F.lit("XI111").alias("TIN"))).alias("LodgingPerson"),
        F.struct(F.lit("XI222").alias("TIN")).alias("Carrier"),
        F.transform(countries, lambda x: F.struct(x.alias("CountryCode"))).alias("Itinerary"),
        F.when(k % 59 != 0, F.transform(upto(k % 3 + 1, 3), lambda i: _item(k, i))).alias("GoodsItem"),
        F.struct(
            F.when(k % 31 == 0, "XX999999").otherwise(pick(OFFICES, (k * 7) % len(OFFICES))).alias("RefNum"),
            F.when(k % 41 == 0, "unknown")
            .when(k % 5 == 0, join(arrival, " 0630"))
            .otherwise(join(arrival, "0630"))
            .alias("ExpectedDateTimeOfArrival"),
        ).alias("CustOfficeOfFirstEntry"),
        F.transform(offices, lambda x: F.struct(x.alias("RefNum"))).alias("CustOfficeOfSubsequentEntry"),
        seals.alias("Seal"),
    )
    interchange = F.struct(
        F.lit("1").alias("Version"),
        F.lit("SENDER").alias("SenderID"),
        F.lit("RECIPIENT").alias("RecipientID"),
        join("REF_", k).alias("InterchangeReference"),
        F.lit("SCS").alias("Application"),
        F.lit("KSD315").alias("MsgType"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("Date"),
        F.lit("1517").alias("Time"),
        F.lit("0").alias("TestIndicator"),
    )
    # Documents are wide and built from narrow rows: spread the rows first, whatever the file layout. In turn and not
    # by key, since one key, or null, may own a third of the rows and nothing here needs a key's rows together.
    # A fixed number, since AQE would judge the partitions by the narrow rows and merge them, but one for each core.
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.repartition(spread).select(
        k.alias("doc"),
        join("D", k, ".xml").alias("file_name"),
        interchange.alias("Interchange"),
        declaration.alias("EntrySummaryDeclaration"),
    )


DOCS_SQL = f"""
docs AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'LRN' || o_orderkey AS lrn, 'D' || o_orderkey || '.xml' AS file_name,
    {sql_list(IMOS)}[o_custkey % {len(IMOS)} + 1] AS imo, 'V' || (o_orderkey % 500) AS voyage,
    CASE WHEN o_orderkey % 43 <> 0 THEN {sql_list(ROUTED)}[o_orderkey % {len(ROUTED)} + 1] END AS pol,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'GBBEL' WHEN o_orderkey % 37 = 0 THEN ''
      ELSE {sql_list(ROUTED)}[(o_orderkey // 18 + o_orderkey * 5) % {len(ROUTED)} + 1] END AS pou,
    {sql_list(PORTS)}[o_orderkey % {len(PORTS)} + 1] AS decl_place,
    CASE WHEN o_orderkey % 13 = 1 THEN '  ' WHEN o_orderkey % 13 > 1 THEN 'CR' || (o_orderkey // 2) END AS commercial_ref,
    CASE WHEN o_orderkey % 31 = 0 THEN 'XX999999' ELSE {sql_list(OFFICES)}[(o_orderkey * 7) % {len(OFFICES)} + 1] END AS office,
    strftime(o_orderdate, '%Y%m%d') || '0000' AS decl_time, CAST(o_orderdate AS DATE) AS decl_date,
    CAST(o_orderdate AS DATE) + 10 AS arrival_date,
    CASE WHEN o_orderkey % 41 = 0 THEN 'unknown' ELSE strftime(CAST(o_orderdate AS DATE) + 10, '%Y%m%d')
      || CASE WHEN o_orderkey % 5 = 0 THEN ' 0630' ELSE '0630' END END AS arrival,
    CASE WHEN o_orderkey % 6 <> 0 THEN '9' END AS total_items,
    CAST(o_orderkey % 5000 + 100 AS VARCHAR) AS gross, CAST(o_orderkey % 20 + 1 AS VARCHAR) AS packages,
    CASE WHEN o_orderkey % 59 = 0 THEN 0 ELSE o_orderkey % 3 + 1 END AS n_items,
    o_orderkey % 47 <> 0 AS has_consignor, 'O''Brien & Söhne #' || o_custkey AS consignor_name,
    'Calle Ñandú ' || o_orderkey || ' 100%' AS consignor_address,
    lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS consignor_zip,
    CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'Málaga' END AS consignor_city,
    CASE WHEN o_orderkey % 6 = 1 THEN '' WHEN o_orderkey % 6 > 1 THEN CAST(o_orderkey % 90 AS VARCHAR) END AS consignor_number,
    CASE WHEN o_orderkey % 10 = 0 THEN 'Notify ' ELSE 'Ä°STANBUL Gıda ' END || o_custkey AS consignee_name,
    o_orderkey % 10 <> 0 AS has_consignee,
    'Rue de l''Église; ' || o_orderkey AS consignee_address,
    CASE WHEN o_orderkey % 4 <> 0 THEN '7' END AS consignee_number,
    CASE WHEN o_orderkey % 53 <> 0 THEN 'XI111' END AS lodging_tin, 'XI222' AS carrier_tin
  FROM orders),
lists AS (
  SELECT k, CASE k % 3 WHEN 0 THEN [substr(coalesce(pol, 'ZZ'), 1, 2), substr(coalesce(pou, 'ZZ'), 1, 2)]
      WHEN 1 THEN ['EG', 'TR', 'IT', 'FR', 'ES'] ELSE [' IL ', 'CY'] END AS itinerary,
    CASE k % 4 WHEN 1 THEN ['GB000080', 'FR002730'] WHEN 2 THEN ['FR002730', 'ES000811']
      WHEN 3 THEN ['IEDUB100'] ELSE CAST([] AS VARCHAR[]) END AS offices FROM docs),
goods AS (
  SELECT k, i, CASE WHEN k % 4 <> 0 THEN CAST(i * 10 AS VARCHAR) END AS item_number,
    {sql_list(ADJECTIVES)}[(k + i) % 8 + 1] || ' ' || {sql_list(NOUNS)}[(k * 3 + i) % 8 + 1]
      || CASE WHEN (k + i) % 5 = 0 THEN ' #é' ELSE '' END AS description,
    CASE (k + i) % 7 WHEN 0 THEN NULL WHEN 1 THEN '70191' WHEN 2 THEN '7019.12' WHEN 3 THEN ''
      ELSE lpad(CAST((k * 613 + i) % 1000000 AS VARCHAR), 6, '0') END AS tariff,
    CASE WHEN (k * i) % 5 = 0 THEN lpad(CAST((k * 7 + i) % 1000000 AS VARCHAR), 6, '0') END AS harmonized,
    CAST(k % 1000 + i AS VARCHAR) AS gross, CASE WHEN (k + i) % 4 = 0 THEN '1263' END AS un_number,
    'MK' || i AS marks, packages
  FROM (SELECT k, packages, unnest(range(1, n_items + 1)) AS i FROM docs)),
boxes AS (
  SELECT k, i, j, 'MCLU' || lpad(CAST((k * 10 + i * 3 + j) % 10000000 AS VARCHAR), 7, '0') AS container
  FROM (SELECT k, i, unnest(range(1, (k + i) % 3 + 1)) AS j FROM goods)),
seals AS (
  SELECT k, 'MCLU' || lpad(CAST((k * 10 + 4) % 10000000 AS VARCHAR), 7, '0') AS container,
    CASE WHEN k % 6 <> 0 THEN 'S' || lpad(CAST(k * 3 + 1 AS VARCHAR), 8, '0')
      WHEN k % 5 <> 0 THEN 'S' || lpad(CAST(k * 3 + 2 AS VARCHAR), 8, '0') END AS seal
  FROM docs)
"""

ROUTES_SQL = (
    "routes(imo, route, ports) AS (VALUES "
    + ", ".join(
        f"('{imo}', '{route}', {sql_list(ROUTE_PORTS[route])})"
        for route, imos in (
            ("WCUK", ["9242558", "9242560", "9246530", "9246554", "9354428"]),
            ("WM", ["9212010", "9212034", "9429209", "1016575", "1016563"]),
            ("ADR", ["9390824", "9336294"]),
        )
        for imo in imos
    )
    + ")"
)

OFFICES_SQL = "office_of(port, ref_num) AS (VALUES " + ", ".join(f"('{p}', '{o}')" for p, o in PORT_OFFICES.items()) + ")"


# --- flat goods items: one per order line, its lineitem rows are the containers -------------------


def goods_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.sum("l_quantity").alias("packages")
    )
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    part = F.col("part")
    return lines.join(names, "part").select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").cast("long").alias("pos"),
        F.when(part % 4 != 0, text(F.col("l_linenumber") * 10)).alias("item_number"),
        F.when(part % 17 != 0, F.col("p_name")).alias("description"),
        F.when(part % 11 == 1, " ")
        .when(part % 11 == 2, "7019.12")
        .when(part % 11 > 2, text(part * 613))
        .alias("tariff"),
        F.when(part % 13 == 0, digits(part % 1000000, 6)).alias("harmonized"),
        F.col("packages").cast("long").alias("packages"),
    )


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: item ``pos`` of ``doc`` travels in ``container``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").cast("long").alias("pos"),
        join("CONT", (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100000).alias("container"),
    )


def seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals in document order; some without id or container, several for one container."""
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        (line * 1000000 + part * 100 + supp % 100).cast("long").alias("pos"),
        F.when(part % 5 == 0, "").otherwise(join("SL", part, "-", supp)).alias("seal"),
        F.when(supp % 7 != 0, join("CONT", (part * 7 + supp) % 100000)).alias("container"),
    )


def container_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size-type lookup that knows some containers and has empty values."""
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        join("CONT", part * 7).alias("container"), F.when(part % 3 == 0, "").otherwise(join("2", part % 10)).alias("size_type")
    )


FLAT_SQL = """
flat_items AS (
  SELECT doc, pos, CASE WHEN part % 4 <> 0 THEN CAST(pos * 10 AS VARCHAR) END AS item_number,
    CASE WHEN part % 17 <> 0 THEN p_name END AS description,
    CASE WHEN part % 11 = 0 THEN NULL WHEN part % 11 = 1 THEN ' ' WHEN part % 11 = 2 THEN '7019.12'
      ELSE CAST(part * 613 AS VARCHAR) END AS tariff,
    CASE WHEN part % 13 = 0 THEN lpad(CAST(part % 1000000 AS VARCHAR), 6, '0') END AS harmonized, packages
  FROM (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS pos, min(l_partkey) AS part,
      CAST(sum(l_quantity) AS BIGINT) AS packages FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = part),
flat_containers AS (
  SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS pos,
    'CONT' || ((l_partkey * 7 + l_suppkey) % 100000) AS container FROM lineitem),
flat_seals AS (
  SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS pos,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'SL' || l_partkey || '-' || l_suppkey END AS seal,
    CASE WHEN l_suppkey % 7 <> 0 THEN 'CONT' || ((l_partkey * 7 + l_suppkey) % 100000) END AS container FROM lineitem),
types AS (
  SELECT 'CONT' || (p_partkey * 7) AS container,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2' || (p_partkey % 10) END AS size_type FROM part)
"""
