"""Header updates of nested declarations; every rule is an expression inside the row.

Frames hold ``doc``, ``file_name``, ``Interchange`` and ``EntrySummaryDeclaration``. Results keep the
input columns, so a rewritten set goes to a new location with its ``changed`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensspark import schemas
from ensspark.functions.nested import has_empty_leaf, map_leaves
from ensspark.functions.text import clean_if_dirty, strip_specials
from ensspark.functions.values import blank, existing, iso_date, midnight_stamp, same_text
from ensspark.operators.routing import gb_status, with_route
from ensspark.operators.tariff import default_missing_items, document_valid

DECL = "EntrySummaryDeclaration"

# An XML declaration, and an element with nothing but white space in a text without comments and the like.
XML_1_0 = r"""^<\?xml version=["']1\.0["'][^?<>]*\?>"""
BLANK_LEAF = r"""<[^\s/>!?<]++(?:\s+[^\s=/><]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*(?:/>|>[ \t\r\n]*</)"""


def tax_id(port: Column, gb_tin: str, other_tin: str) -> Column:
    """Tax id that goes with a port of declaration."""
    return F.when(F.upper(port).isin(schemas.GB_TAX_PORTS), gb_tin).otherwise(other_tin)


def with_number(party: Column) -> Column:
    """A party that exists gets a house number; an empty one counts as given."""
    return party.withField("Number", F.coalesce(party["Number"], F.lit(schemas.NOT_AVAILABLE)))


def _with_tin(party: Column, tin: Column) -> Column:
    """Set the tax id of a party that has one.

    Nested structs are rebuilt one level at a time throughout this module: a dotted ``withField``
    path repeats the whole column for every level, which multiplies along a chain.
    """
    return party.withField("TIN", existing(party["TIN"], tin))


def update_headers(
    docs: DataFrame,
    voyage: Column,
    imo: Column,
    port: Column,
    arrival: Column,
    ref_num: Column,
    gb_tin: str,
    other_tin: str,
) -> DataFrame:
    """Set voyage, vessel, place, office, arrival and tax ids of existing tags; add house numbers.

    ``arrival`` is yyyy-MM-dd text; where it is no date the document stays as it is and ``error``
    says so. An empty ``ref_num`` (unknown port) keeps the office.
    """
    d = F.col(DECL)
    stamp = midnight_stamp(iso_date(arrival))
    tin = tax_id(port, gb_tin, other_tin)
    office = d["CustOfficeOfFirstEntry"]
    new = (
        d.withField("ConveyanceRefNum", existing(d["ConveyanceRefNum"], voyage))
        .withField("IdeOfMeaOfTraCro", existing(d["IdeOfMeaOfTraCro"], imo))
        .withField("DeclPlace", existing(d["DeclPlace"], port))
        .withField(
            "CustOfficeOfFirstEntry",
            office.withField("RefNum", existing(office["RefNum"], F.nullif(ref_num, F.lit("")))).withField(
                "ExpectedDateTimeOfArrival", existing(office["ExpectedDateTimeOfArrival"], stamp)
            ),
        )
        .withField("Consignor", with_number(d["Consignor"]))
        .withField("Consignee", with_number(d["Consignee"]))
        .withField("LodgingPerson", _with_tin(d["LodgingPerson"], tin))
        .withField("Carrier", _with_tin(d["Carrier"], tin))
    )
    bad = iso_date(arrival).isNull()
    return (
        docs.withColumn("error", F.when(bad, F.concat(F.lit("Invalid date format: "), F.coalesce(arrival, F.lit("")))))
        .withColumn("_new", F.when(bad, d).otherwise(new))
        .withColumn("changed", ~F.col("_new").eqNullSafe(d))
        .withColumn(DECL, F.col("_new"))
        .drop("_new")
    )


def _set(old: Column, new: Column) -> Column:
    """Replace existing text unless the new one is blank or differs only by case."""
    keep = old.isNull() | blank(new) | same_text(old, new)
    return F.when(keep, old).otherwise(new)


def batch_update(docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set up to five header tags, default missing tariff codes, add house numbers.

    ``values`` keys: IdeOfMeaOfTraCro, ConveyanceRefNum, DeclPlace, RefNum,
    ExpectedDateTimeOfArrival; blank values are skipped. Adds ``tariff_valid`` (of the input) and
    ``changed``.
    """
    d = F.col(DECL)
    old_office = d["CustOfficeOfFirstEntry"]
    new, office = d, old_office
    for tag in ("IdeOfMeaOfTraCro", "ConveyanceRefNum", "DeclPlace"):
        if tag in values:
            new = new.withField(tag, _set(d[tag], values[tag]))
    for tag in ("RefNum", "ExpectedDateTimeOfArrival"):
        if tag in values:
            office = office.withField(tag, _set(old_office[tag], values[tag]))
    new = (
        new.withField("CustOfficeOfFirstEntry", office)
        .withField("Consignor", with_number(d["Consignor"]))
        .withField("Consignee", with_number(d["Consignee"]))
        .withField("GoodsItem", default_missing_items(d["GoodsItem"]))
    )
    return (
        docs.withColumn("tariff_valid", document_valid(d["GoodsItem"]))
        .withColumn("_new", new)
        .withColumn("changed", ~F.col("_new").eqNullSafe(d))
        .withColumn(DECL, F.col("_new"))
        .drop("_new")
    )


def batch_summary(updated: DataFrame) -> DataFrame:
    """Documents, changed documents and errors of an update run."""
    failed = F.col("error").isNotNull() if "error" in updated.columns else F.lit(False)
    return updated.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("changed").alias("changed_documents"),
        F.count_if(failed).alias("errors"),
    )


# --- GB filings ---------------------------------------------------------------------------------


def renumber_items(goods: Column) -> Column:
    """Number the items that carry an ItemNumber tag 1..n in document order; others stay."""
    placed = F.transform(goods, lambda item, i: F.struct(i.alias("i"), item.alias("item")))
    numbered = F.filter(placed, lambda x: x["item"]["ItemNumber"].isNotNull())
    counted = F.transform(
        numbered,
        lambda x, n: F.struct(
            x["i"].alias("i"), x["item"].withField("ItemNumber", (n + 1).cast("string")).alias("item")
        ),
    )
    others = F.filter(placed, lambda x: x["item"]["ItemNumber"].isNull())
    return F.transform(F.array_sort(F.concat(counted, others)), lambda x: x["item"])


def numbered_items(goods: Column) -> Column:
    """How many items carry an ItemNumber tag."""
    numbers = F.filter(goods, lambda item: item["ItemNumber"].isNotNull())
    return F.coalesce(F.size(numbers), F.lit(0))


def gb_rewrite(
    docs: DataFrame,
    imo: Column,
    voyage: Column,
    arrival_day: Column,
    gb_tin: str,
    itinerary: Column | None = None,
    place: str = schemas.GB_PORT,
    office: str = schemas.GB_OFFICE,
) -> DataFrame:
    """Rewrite declarations for a GB filing and pick their queue.

    ``arrival_day`` is yyyyMMdd text; ``itinerary``, if given, an array of country codes. Sets
    existing tags, renumbers items, strips special characters from every text, then sends documents
    with an empty tag to the problematic queue.
    """
    d = F.col(DECL)
    first = d["CustOfficeOfFirstEntry"]
    goods = d["GoodsItem"]
    new = (
        d.withField("IdeOfMeaOfTraCro", _set(d["IdeOfMeaOfTraCro"], imo))
        .withField("ConveyanceRefNum", _set(d["ConveyanceRefNum"], voyage))
        .withField("DeclPlace", _set(d["DeclPlace"], F.lit(place)))
        .withField(
            "CustOfficeOfFirstEntry",
            first.withField("RefNum", _set(first["RefNum"], F.lit(office))).withField(
                "ExpectedDateTimeOfArrival",
                _set(first["ExpectedDateTimeOfArrival"], F.concat(arrival_day, F.lit("0000"))),
            ),
        )
        .withField("LodgingPerson", _with_tin(d["LodgingPerson"], F.lit(gb_tin)))
        .withField("Carrier", _with_tin(d["Carrier"], F.lit(gb_tin)))
        .withField("GoodsItem", renumber_items(goods))
        .withField(
            "TotalNumberOfItems", existing(d["TotalNumberOfItems"], numbered_items(goods).cast("string"))
        )
    )
    if itinerary is not None:
        codes = F.transform(itinerary, lambda code: F.struct(code.alias("CountryCode")))
        new = new.withField("Itinerary", F.coalesce(codes, d["Itinerary"]))
    rewritten = docs.withColumn("_new", new).withColumn(
        "_new", map_leaves(F.col("_new"), schemas.DECLARATION, strip_specials)
    )
    return (
        rewritten.withColumn("changed", ~F.col("_new").eqNullSafe(d))
        .withColumn(DECL, F.col("_new"))
        .drop("_new")
        .withColumn("empty_tag", empty_tag())
        .withColumn("queue", F.when(F.col("empty_tag"), "GB-Filings/Problematic").otherwise("GB-Filings"))
    )


def empty_tag() -> Column:
    """True where some known tag of the document is present and blank."""
    return has_empty_leaf(F.col("Interchange"), schemas.INTERCHANGE) | has_empty_leaf(
        F.col(DECL), schemas.DECLARATION
    )


def empty_tag_in_text(xml: Column, corrupt: Column) -> Column:
    """The same over raw text, unknown tags included. Null for text that is not well-formed.

    XPath fails a job on malformed input, so the corrupt marker of the typed parse guards it. In a text of tags and
    plain characters alone, a blank leaf is a start tag followed by white space and an end tag, so no tree is built;
    texts with comments, CDATA, instructions or character references go through XPath.
    """
    body = F.regexp_replace(xml, XML_1_0, "")
    other = (xml == "") | F.contains(body, F.lit("<!")) | F.contains(body, F.lit("<?")) | F.contains(body, F.lit("&#"))
    blank_leaf = F.xpath_boolean(xml, F.lit("//*[not(*) and normalize-space(.)='']"))
    return F.when(corrupt.isNull(), F.when(other, blank_leaf).otherwise(body.rlike(BLANK_LEAF)))


def queue_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("queue").agg(F.count(F.lit(1)).alias("documents"))


def latest_by_file_name(files: DataFrame, position: str) -> DataFrame:
    """Of files with one name in several folders, the one from the last folder.

    A partial aggregate: a name that fills a third of the rows is reduced before the shuffle.
    """
    values = [c for c in files.columns if c != "file_name"]
    last = files.groupBy("file_name").agg(F.max_by(F.struct(*values), position).alias("_last"))
    return last.select("file_name", "_last.*")


def prepare_gb(
    found: DataFrame,
    routes: DataFrame,
    imo: Column,
    voyage: Column,
    arrival_day: Column,
    gb_tin: str,
    itinerary: Column | None = None,
) -> DataFrame:
    """Documents of the loading-port folders that need a GB filing, rewritten, with their queue.

    ``found`` comes from ``read_gb_candidates``. Documents that unload before the GB port are left out, and of files
    with one name the one from the last folder counts.
    """
    ship, unloading = F.col(DECL)["IdeOfMeaOfTraCro"], F.col(DECL)["PlaceOfUnloading"]
    routed = with_route(found, routes, ship)
    due = routed.filter(gb_status(F.col("ports"), unloading) == "required").select(*found.columns)
    return gb_rewrite(latest_by_file_name(due, "folder_pos"), imo, voyage, arrival_day, gb_tin, itinerary)


# --- parties of converted documents ---------------------------------------------------------------


def clean_f10_party(party: Column) -> Column:
    """Clean name and address texts that hold a forbidden character; fill in the house number."""
    address = party["Address"]
    fields = ("city", "country", "street", "postCode")
    cleaned = address
    for field in fields:
        cleaned = cleaned.withField(field, clean_if_dirty(address[field]))
    number = F.coalesce(F.nullif(address["number"], F.lit("")), F.lit(schemas.NOT_AVAILABLE))
    cleaned = cleaned.withField("number", clean_if_dirty(number))
    return party.withField("name", clean_if_dirty(party["name"])).withField("Address", cleaned)


def clean_f10(filing: Column) -> Column:
    """Clean the four parties of a filing that already has the new layout."""
    body = filing["SMFENS2FilingBody"]
    master = body["ConsignmentMasterLevel"]
    house = master["ConsignmentHouseLevel"]
    shipment = house["GoodsShipment"]
    traders = shipment.withField("Buyer", clean_f10_party(shipment["Buyer"])).withField(
        "Seller", clean_f10_party(shipment["Seller"])
    )
    cleaned = (
        house.withField("Consignee", clean_f10_party(house["Consignee"]))
        .withField("Consignor", clean_f10_party(house["Consignor"]))
        .withField("GoodsShipment", traders)
    )
    return filing.withField(
        "SMFENS2FilingBody",
        body.withField("ConsignmentMasterLevel", master.withField("ConsignmentHouseLevel", cleaned)),
    )
