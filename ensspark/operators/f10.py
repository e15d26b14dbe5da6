"""Conversion of old-format declarations to the F10 filing layout.

Documents keep their arrays in the row, so the conversion itself is one projection. Only lookups the
caller supplies (container types, HS codes) move data. The flat functions at the end do the same
work on rows per item and container, for documents too large for one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensspark import schemas
from ensspark.functions.nested import bound, map_struct
from ensspark.functions.tariff import six_long
from ensspark.functions.text import WHITESPACE_RUN, clean
from ensspark.functions.values import document_time, or_default, zulu
from ensspark.operators.headers import DECL
from ensspark.operators.numbering import number_rows
from ensspark.operators.routing import repair_routes, with_route
from ensspark.operators.skew import splittable

# Fixed value: the reason of a refused document.
HS_FAILED = "Failed HS Code Check"


@dataclass(frozen=True)
class Company:
    """The carrier that files, and the addresses of the filing service; the defaults are invented."""

    name: str = "EXAMPLE CARRIER"
    tax_id: str = "XI000000000000"
    city: str = "PORT CITY"
    country: str = "GB"
    street: str = "QUAY STREET"
    post_code: str = "AA1 1AA"
    number: str = "1"
    email: str = "filing@example.com"
    sender_id: str = "000000000"
    recipient_id: str = "RECIPIENT"
    action: str = "urn:example:filing"
    test_indicator: str = "P"
    correlation_id: str = "00000000-0000-0000-0000-000000000000"


# --- preparation ----------------------------------------------------------------------------------


def normalize_value(value: Column) -> Column:
    """Text rules of the raw document, applied to one parsed value."""
    repaired = value
    for old, new in (("&;", " and "), ("'", ""), ("&", " and ")):
        repaired = F.replace(repaired, F.lit(old), F.lit(new))
    # most values have nothing to repair: one search tells
    return F.when(value.rlike(f"[&']|{WHITESPACE_RUN}"), F.regexp_replace(repaired, WHITESPACE_RUN, " ")).otherwise(value)


def merge_parties(docs: DataFrame) -> DataFrame:
    """A notify party stands in for a missing consignee."""
    d = F.col(DECL)
    merged = d.withField("Consignee", F.coalesce(d["Consignee"], d["NotifyParty"]))
    return docs.withColumn(DECL, merged.withField("NotifyParty", F.lit(None).cast(schemas.PARTY)))


def drop_gb_office(docs: DataFrame, office: str = schemas.GB_OFFICE) -> DataFrame:
    """Take the GB office out of the subsequent offices."""
    d = F.col(DECL)
    kept = F.filter(d["CustOfficeOfSubsequentEntry"], lambda o: ~o["RefNum"].eqNullSafe(F.lit(office)))
    return docs.withColumn(DECL, d.withField("CustOfficeOfSubsequentEntry", kept))


def prepare(docs: DataFrame) -> DataFrame:
    """Everything that precedes the route repair, on parsed documents."""
    d = F.col(DECL)

    def house_number(party: Column) -> Column:
        number = F.when(party["Number"] == "00", schemas.NOT_AVAILABLE).otherwise(party["Number"])
        return party.withField("Number", number)

    tidy = docs.withColumn(DECL, map_struct(d, schemas.DECLARATION, normalize_value))
    merged = drop_gb_office(merge_parties(tidy))
    return merged.withColumn(
        DECL,
        d.withField("Consignor", house_number(d["Consignor"])).withField("Consignee", house_number(d["Consignee"])),
    )


def repair(docs: DataFrame, routes: DataFrame, offices: dict[str, str] | None = None) -> DataFrame:
    """Route repair of nested documents; adds ``corrections``."""
    d = F.col(DECL)
    fixed = repair_routes(
        with_route(docs, routes, d["IdeOfMeaOfTraCro"]),
        ports=F.col("ports"),
        pol=d["PlaceOfLoading"],
        pou=d["PlaceOfUnloading"],
        first_office=d["CustOfficeOfFirstEntry"]["RefNum"],
        itinerary=d["Itinerary"]["CountryCode"],
        offices=d["CustOfficeOfSubsequentEntry"]["RefNum"],
        known_offices=offices,
    )
    countries = F.transform("new_itinerary", lambda c: F.struct(c.alias("CountryCode")))
    codes = F.transform("new_offices", lambda c: F.struct(c.alias("RefNum")))
    return fixed.withColumn(
        DECL, d.withField("Itinerary", countries).withField("CustOfficeOfSubsequentEntry", codes)
    ).drop("new_itinerary", "new_offices", "route", "ports")


# --- lookups --------------------------------------------------------------------------------------


def _lookups(docs: DataFrame, key: str, wanted: dict[str, tuple[Column, DataFrame]]) -> DataFrame:
    """Map columns with the lookup rows a document needs, keys in upper case: ``{name: (keys, lookup)}``.

    All lookups share one pass: only tagged distinct keys travel to the join, and one join brings the answers back.
    What comes back per document is no larger than the arrays it came from, which already fit in the row. Documents
    that share a key share the maps.
    """
    if not wanted:
        return docs

    def tagged(name: str, values: Column) -> Column:
        pairs = F.transform(F.array_distinct(values), lambda k: F.struct(F.lit(name).alias("_kind"), k.alias("_k")))
        return F.coalesce(pairs, F.array().cast("array<struct<_kind:string,_k:string>>"))

    tables = []
    for name, (_, lookup) in wanted.items():
        word, answer = lookup.columns
        tables.append(lookup.select(F.lit(name).alias("_kind"), F.upper(word).alias("_k"), F.col(answer).alias("_v")))
    keys = [tagged(name, values) for name, (values, _) in wanted.items()]
    table = reduce(DataFrame.unionAll, tables).groupBy("_kind", "_k").agg(F.min("_v").alias("_v"))
    needed = docs.select(key, F.inline(F.concat(*keys))).filter("_k IS NOT NULL")
    hits = needed.join(splittable(table, "_kind", "_k"), ["_kind", "_k"]).groupBy(key)
    # documents are wide: hash the answers rather than sort the documents
    answered = hits.agg(F.collect_set(F.struct("_kind", "_k", "_v")).alias("_hits"))
    found = docs.join(answered.hint("shuffle_hash"), key, "left")

    def answers(name: str) -> Column:
        own = F.filter("_hits", lambda h: h["_kind"] == name)
        return F.map_from_entries(F.transform(own, lambda h: F.struct(h["_k"], h["_v"])))

    return found.withColumns({name: answers(name) for name in wanted}).drop("_hits")


def hs_code(tariff: Column, harmonized: Column, looked_up: Column) -> Column:
    """Harmonized heading first, then tariff number, then the code of the description."""
    return F.coalesce(harmonized, tariff, looked_up)


def enrich(
    docs: DataFrame,
    flags: DataFrame,
    container_types: DataFrame | None = None,
    hs_codes: DataFrame | None = None,
    key: str = "doc",
) -> DataFrame:
    """Add ``flag``, ``size_types``, ``seal_of`` and, by place of the goods item, ``descriptions`` and ``item_hs``.

    ``flags(imo, flag)``, ``container_types(container, size_type)``, ``hs_codes(description, code)``.
    """
    d = F.col(DECL)
    wanted = {}
    if container_types is not None:
        boxes = F.flatten(F.filter(d["GoodsItem"]["Container"], lambda c: c.isNotNull()))
        wanted["size_types"] = F.transform(boxes, lambda c: F.upper(c["ContainerNumber"])), container_types
    if hs_codes is not None:
        uncoded = F.filter(
            d["GoodsItem"],
            lambda g: g["harmonizedSystemSubHeadingCode"].isNull() & g["TariffNumber"].isNull(),
        )
        wanted["hs_lookup"] = F.transform(uncoded, lambda g: F.upper(clean(g["Description"]))), hs_codes
    docs = _lookups(docs, key, wanted)  # first, so that the branch of the keys reads nothing else
    state = flags.select(F.col("imo").alias("_imo"), "flag")
    docs = docs.withColumn("_imo", d["IdeOfMeaOfTraCro"]).join(state, "_imo", "left").drop("_imo")
    docs = docs.withColumn("flag", F.coalesce("flag", F.lit("")))
    empty = F.lit(None).cast("map<string,string>")
    docs = docs.withColumns({name: empty for name in ("size_types", "hs_lookup") if name not in wanted})
    # each in a step of its own: what several expressions read is then computed once
    docs = docs.withColumn("descriptions", F.transform(d["GoodsItem"], lambda g: clean(g["Description"])))
    docs = docs.withColumn("item_hs", F.transform(d["GoodsItem"], lambda g, i: _item_hs(g, i, F.col("hs_lookup"))))
    return docs.withColumn("seal_of", first_seals_of(d["Seal"])).drop("hs_lookup")


def _item_hs(item: Column, i: Column, hs_lookup: Column) -> Column:
    found = F.try_element_at(hs_lookup, F.upper(F.get(F.col("descriptions"), i)))
    return hs_code(item["TariffNumber"], item["harmonizedSystemSubHeadingCode"], found)


def first_seals_of(seals: Column) -> Column:
    """Map from container, in upper case, to its first seal that names both itself and a container.

    Built from the sorted seals, so that containers need not search all seals.
    """
    usable = F.filter(
        seals,
        lambda s: (F.coalesce(s["SealID"], F.lit("")) != "") & (F.coalesce(s["ContainerNumber"], F.lit("")) != ""),
    )
    placed = F.transform(
        usable, lambda s, i: F.struct(F.upper(s["ContainerNumber"]).alias("box"), i.alias("pos"), s["SealID"].alias("seal"))
    )

    def first(own: Column) -> Column:
        kept = F.filter(own, lambda s, i: (i == 0) | (F.get(own, i - 1)["box"] != s["box"]))
        return F.map_from_entries(F.transform(kept, lambda s: F.struct(s["box"], s["seal"])))

    return bound(F.array_sort(placed), first)


# --- conversion -----------------------------------------------------------------------------------


def party_value(party: Column, field: str) -> Column:
    """Cleaned party text: empty where missing, N/A for a missing house number of a known party."""
    missing = schemas.NOT_AVAILABLE if field == "Number" else ""
    value = F.coalesce(clean(F.nullif(party[field], F.lit(""))), F.lit(missing))
    return F.when(party.isNull(), "").otherwise(value)


def party_warnings(party: Column, kind: str) -> Column:
    """What is missing in a party, as texts."""
    fields = ["Name", "City", "Country", "Address", "ZipCode"]
    absent = [F.when(F.coalesce(party[f], F.lit("")) == "", F.lit(f"{kind} {f} is missing or empty")) for f in fields]
    return F.when(party.isNull(), F.array(F.lit(f"{kind} is missing"))).otherwise(F.array_compact(F.array(*absent)))


def _party(party: Column) -> Column:
    return F.struct(
        party_value(party, "Name").alias("name"),
        F.lit("2").alias("typeOfPerson"),
        F.struct(
            party_value(party, "City").alias("city"),
            party_value(party, "Country").alias("country"),
            party_value(party, "Address").alias("street"),
            party_value(party, "ZipCode").alias("postCode"),
            party_value(party, "Number").alias("number"),
        ).alias("Address"),
    )


def _given(value: Column) -> Column:
    """The layout always has the tag, so a missing value becomes empty text."""
    return F.coalesce(value, F.lit(""))


def _equipment(container: Column, seal_of: Column, size_types: Column) -> Column:
    number = F.upper(container["ContainerNumber"])
    seal = F.try_element_at(seal_of, number)
    return F.struct(
        or_default(F.try_element_at(size_types, number), schemas.DEFAULT_CONTAINER_TYPE).alias("containerSizeAndType"),
        F.lit("B").alias("containerPackedStatus"),
        F.lit("2").alias("containerSupplierType"),
        _given(container["ContainerNumber"]).alias("containerIdentificationNumber"),
        F.when(seal.isNull(), "0").otherwise("1").alias("numberOfSeals"),
        F.struct(F.coalesce(seal, F.lit("None")).alias("identifier")).alias("Seal"),
    )


def _goods_item(item: Column, i: Column, seal_of: Column, size_types: Column) -> Column:
    return F.struct(
        (i + 1).cast("string").alias("goodsItemNumber"),
        F.struct(
            _given(F.get(F.col("descriptions"), i)).alias("descriptionOfGoods"),
            F.struct(F.get(F.col("item_hs"), i).alias("harmonizedSystemSubHeadingCode")).alias("CommodityCode"),
            F.struct(_given(item["UnDangerousGoodsCode"]).alias("unNumber")).alias("DangerousGoods"),
        ).alias("Commodity"),
        F.struct(_given(item["GrossWeight"]).alias("grossMass")).alias("Weight"),
        F.struct(
            _given(item["Package"]["Marks"]).alias("shippingMarks"),
            _given(item["Package"]["NumberOfPackages"]).alias("numberOfPackages"),
            _given(item["Package"]["KindOfPackage"]).alias("typeOfPackages"),
        ).alias("Packaging"),
        F.transform(item["Container"], lambda c: _equipment(c, seal_of, size_types)).alias("TransportEquipment"),
    )


def _company(company: Company, contact: bool) -> Column:
    parts = [
        F.lit(company.name).alias("name"),
        F.lit(company.tax_id).alias("identificationNumber"),
        F.struct(
            F.lit(company.city).alias("city"),
            F.lit(company.country).alias("country"),
            F.lit(company.street).alias("street"),
            F.lit(company.post_code).alias("postCode"),
            F.lit(company.number).alias("number"),
        ).alias("Address"),
    ]
    if contact:
        parts.append(
            F.struct(F.lit(company.email).alias("identifier"), F.lit("EM").alias("type")).alias("Communication")
        )
    return F.struct(*parts)


def reject_reason() -> Column:
    """Why an enriched document cannot be converted; null if it can."""
    d = F.col(DECL)
    bad_hs = F.exists("item_hs", lambda code: ~six_long(code))
    return (
        F.when(F.coalesce(bad_hs, F.lit(False)), HS_FAILED)
        .when(document_time(d["DeclDateTime"]).isNull(), "Invalid DeclDateTime")
        .when(
            document_time(d["CustOfficeOfFirstEntry"]["ExpectedDateTimeOfArrival"]).isNull(),
            "Invalid ExpectedDateTimeOfArrival",
        )
    )


def build(enriched: DataFrame, issued: Column, company: Company, rejects: bool = True) -> DataFrame:
    """Add ``F10`` (the nested filing, null for rejects), ``f10_name`` and ``reject_reason``.

    Without ``rejects`` refused documents are left out. ``F10`` is then a plain struct, so that the optimizer drops the
    parts of the filing that nobody reads, with what they are made of, before documents are shuffled.
    ``issued`` is the issue timestamp. The departure estimate is three days before the declaration.
    """
    d = F.col(DECL)
    office = d["CustOfficeOfFirstEntry"]
    departure = document_time(d["DeclDateTime"]) - F.expr("INTERVAL 3 DAYS")
    consignee, consignor = _party(d["Consignee"]), _party(d["Consignor"])
    means = F.struct(
        F.concat(F.lit("IMO"), _given(d["IdeOfMeaOfTraCro"])).alias("identificationNumber"),
        F.lit("10").alias("typeOfIdentification"),
        F.lit("150").alias("typeOfMeansOfTransport"),
        F.col("flag").alias("nationality"),
        F.lit("1").alias("modeOfTransport"),
        zulu(departure).alias("estimatedDateAndTimeOfDeparture"),
        zulu(document_time(office["ExpectedDateTimeOfArrival"])).alias("estimatedDateAndTimeOfArrival"),
        F.transform(
            d["Itinerary"],
            lambda c, i: F.struct((i + 1).cast("string").alias("sequenceNumber"), c["CountryCode"].alias("country")),
        ).alias("CountriesOfRoutingOfMeansOfTransport"),
    )

    def unlocode(value: Column) -> Column:
        return F.struct(_given(value).alias("unlocode"))

    house = F.struct(
        F.lit("1").alias("containerIndicator"),
        _given(d["TotalGrossWeight"]).alias("totalGrossMass"),
        unlocode(d["DeclPlace"]).alias("PlaceOfAcceptance"),
        consignee.alias("Consignee"),
        bound(
            F.struct(F.col("seal_of").alias("seal"), F.col("size_types").alias("size")),
            lambda m: F.transform(d["GoodsItem"], lambda g, i: _goods_item(g, i, m["seal"], m["size"])),
        ).alias("GoodsItem"),
        consignor.alias("Consignor"),
        F.struct(_given(d["TransportChargesMethodOfPayment"]).alias("methodOfPayment")).alias("TransportCharges"),
        unlocode(d["PlaceOfUnloading"]).alias("PlaceOfDelivery"),
        F.struct(consignee.alias("Buyer"), consignor.alias("Seller")).alias("GoodsShipment"),
    )
    master = F.struct(
        _company(company, contact=False).alias("Carrier"),
        house.alias("ConsignmentHouseLevel"),
        unlocode(d["PlaceOfLoading"]).alias("PlaceOfLoading"),
        F.struct(
            _given(d["CommercialRefNum"]).alias("documentNumber"),
            _given(F.get(d["GoodsItem"], F.lit(0))["ProducedDocument"]["DocumentType"]).alias("type"),
        ).alias("TransportDocumentMasterLevel"),
        unlocode(d["PlaceOfUnloading"]).alias("PlaceOfUnloading"),
    )
    body = F.struct(
        _given(d["LocalReferenceNumber"]).alias("LRN"),
        F.lit("").alias("ConveyanceRefNum"),
        zulu(issued).alias("documentIssueDate"),
        F.lit("F10").alias("specificCircumstanceIndicator"),
        F.lit("0").alias("reEntryIndicator"),
        F.struct(F.lit("0").alias("splitConsignmentIndicator")).alias("SplitConsignment"),
        means.alias("ActiveBorderTransportMeans"),
        master.alias("ConsignmentMasterLevel"),
        _company(company, contact=True).alias("Declarant"),
        F.struct(_given(office["RefNum"]).alias("referenceNumber")).alias("CustomsOfficeOfFirstEntry"),
        d["CustOfficeOfSubsequentEntry"].alias("CustOfficeOfSubsequentEntry"),
    )
    api = F.struct(
        F.lit(company.sender_id).alias("senderID"),
        F.lit(company.recipient_id).alias("recipientID"),
        F.lit("F10").alias("docType"),
    )
    filing = F.struct(api.alias("SMFAPI"), body.alias("SMFENS2FilingBody"))
    judged = enriched.withColumn("reject_reason", reject_reason()).withColumn(
        "f10_name", F.concat(d["LocalReferenceNumber"], F.lit("_F10"))
    )
    accepted = F.col("reject_reason").isNull()
    return judged.withColumn("F10", F.when(accepted, filing)) if rejects else judged.filter(accepted).withColumn("F10", filing)


def convert(
    docs: DataFrame,
    routes: DataFrame,
    flags: DataFrame,
    issued: Column,
    company: Company | None = None,
    container_types: DataFrame | None = None,
    hs_codes: DataFrame | None = None,
    offices: dict[str, str] | None = None,
    rejects: bool = True,
) -> DataFrame:
    """The whole conversion: prepare, repair routes, look up, reshape; without ``rejects`` converted documents only.

    The result has ``F10`` for converted and ``reject_reason`` for refused documents, the
    ``corrections`` made, and the repaired ``EntrySummaryDeclaration``.
    """
    # Lookups first: their key branches then read the goods items only.
    enriched = enrich(prepare(docs), flags, container_types, hs_codes)
    return build(repair(enriched, routes, offices), issued, company or Company(), rejects)


# --- flattened documents ---------------------------------------------------------------------------


def flatten_goods(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Goods items × containers of nested documents, with the container's first seal.

    Items without containers and documents without items keep a row.
    """
    d = F.col(DECL)

    def box(c: Column, seal_of: Column) -> Column:
        seal = F.try_element_at(seal_of, F.upper(c["ContainerNumber"]))
        return F.struct(c["ContainerNumber"].alias("container"), seal.alias("seal"))

    def item(g: Column, seal_of: Column) -> Column:
        return F.struct(
            g["Description"].alias("description"),
            F.coalesce(g["TariffNumber"], g["harmonizedSystemSubHeadingCode"]).alias("code"),
            g["GrossWeight"].cast("decimal(18,2)").alias("gross_weight"),
            F.transform(g["Container"], lambda c: box(c, seal_of)).alias("boxes"),
        )

    # seals are found before anything is exploded: no row carries a document's seals or an item's other containers
    items = docs.select(key, bound(first_seals_of(d["Seal"]), lambda m: F.transform(d["GoodsItem"], lambda g: item(g, m))).alias("_items"))
    placed = items.select(key, F.posexplode_outer("_items").alias("item_pos", "_item")).select(key, "item_pos", "_item.*")
    boxes = placed.select(
        key, "item_pos", "description", "code", "gross_weight", F.posexplode_outer("boxes").alias("container_pos", "_box")
    )
    return boxes.select(
        key,
        (F.col("item_pos") + 1).alias("item_pos"),
        "description",
        "code",
        "gross_weight",
        (F.col("container_pos") + 1).alias("container_pos"),
        "_box.container",
        "_box.seal",
    )


def item_counts(docs: DataFrame, key: str = "doc") -> DataFrame:
    """How many items, containers, itinerary rows and subsequent offices a document has."""
    d = F.col(DECL)

    def count(values: Column) -> Column:
        return F.coalesce(F.size(values), F.lit(0))

    boxes = F.flatten(F.filter(d["GoodsItem"]["Container"], lambda c: c.isNotNull()))
    return docs.select(
        key,
        count(d["GoodsItem"]).alias("items"),
        count(boxes).alias("containers"),
        count(d["Itinerary"]).alias("itinerary_rows"),
        count(d["CustOfficeOfSubsequentEntry"]).alias("subsequent_offices"),
    )


# --- flat rows -------------------------------------------------------------------------------------


def number_items(items: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """Sequence number of each item in its document, in the order of ``pos``."""
    return number_rows(items, "sequence_number", [key], pos)


def first_seals(seals: DataFrame) -> DataFrame:
    """First usable seal per document and container: ``(doc, container, seal)``.

    ``seals(doc, pos, seal, container)``; a partial aggregate, so no document is too large.
    """
    usable = seals.filter(~F.coalesce(F.col("seal") == "", F.lit(True)) & ~F.coalesce(F.col("container") == "", F.lit(True)))
    return usable.groupBy("doc", F.upper("container").alias("container")).agg(F.min_by("seal", "pos").alias("seal"))


def equipment(containers: DataFrame, seals: DataFrame, types: DataFrame) -> DataFrame:
    """Size type and seal of each container row ``(doc, pos, container)``."""
    sizes = types.groupBy(F.upper("container").alias("_box")).agg(F.min("size_type").alias("size_type"))
    sealed = first_seals(seals).withColumnsRenamed({"container": "_box", "doc": "_doc"})
    keyed = containers.withColumn("_box", F.upper("container"))
    same = (F.col("doc") == F.col("_doc")) & (keyed["_box"] == sealed["_box"])
    return (
        keyed.join(splittable(sealed, "_doc", "_box"), same, "left")
        .drop(sealed["_box"])
        .join(splittable(sizes, "_box"), "_box", "left")
        .select(
            "doc",
            "pos",
            "container",
            or_default(F.col("size_type"), schemas.DEFAULT_CONTAINER_TYPE).alias("size_type"),
            F.coalesce("seal", F.lit("None")).alias("seal"),
            F.when(F.col("seal").isNull(), 0).otherwise(1).alias("seals"),
        )
    )


def resolve_hs(items: DataFrame, hs_codes: DataFrame) -> DataFrame:
    """HS code of flat items; adds ``description_clean``, ``hs`` and ``hs_ok``.

    Only items without a code need the lookup: the others get a null key, and a salt, so that
    they are not piled up on one task.
    """
    word, answer = hs_codes.columns
    table = hs_codes.groupBy(F.upper(word).alias("_key")).agg(F.min(answer).alias("_code"))
    need = F.coalesce("harmonized", "tariff").isNull()
    text = F.upper(clean(F.col("description")))
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("doc", "pos"), F.lit(4096)).cast("string"))
    keyed = items.withColumn("description_clean", clean(F.col("description"))).withColumn(
        "_key", F.when(need & text.isNotNull(), text).otherwise(spread)
    )
    coded = keyed.join(splittable(table, "_key"), "_key", "left").withColumn(
        "hs", hs_code(F.col("tariff"), F.col("harmonized"), F.col("_code"))
    )
    return coded.withColumn("hs_ok", six_long(F.col("hs"))).drop("_key", "_code")

