"""Table schemas, document schemas and fixed reference values."""

from __future__ import annotations

from pyspark.sql import types as T

# --- tracker tables ---------------------------------------------------------------------------

VESSELS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("imo_number", T.StringType()),
    ]
)

VOYAGES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("vessel_id", T.LongType(), False),
        T.StructField("voyage_number", T.StringType(), False),
        T.StructField("service_name", T.StringType()),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("voyage_id", T.LongType(), False),
        T.StructField("port", T.StringType(), False),
        T.StructField("arrival_date", T.DateType(), False),
        T.StructField("is_declared", T.BooleanType()),
        T.StructField("uploaded_files", T.StringType()),
    ]
)

# --- declaration documents --------------------------------------------------------------------
# Every leaf is a string: tariff numbers, seals and postcodes lose leading zeros as numbers.
# The order of the fields is the order of the elements in a written document. The sender's
# password element is left out on purpose, so a typed read drops it.


def _record(*parts: str | tuple[str, T.DataType]) -> T.StructType:
    """Struct of text fields (names separated by blanks) and of ``(name, type)`` pairs, in order."""
    fields: list[T.StructField] = []
    for part in parts:
        if isinstance(part, str):
            fields += [T.StructField(name, T.StringType()) for name in part.split()]
        else:
            fields.append(T.StructField(*part))
    return T.StructType(fields)


INTERCHANGE = _record(
    "Version SenderID RecipientID InterchangeReference Application MsgType Date Time TestIndicator"
)
PARTY = _record("Name Address Country ZipCode City Number")
GOODS_ITEM = _record(
    "ItemNumber Description TariffNumber harmonizedSystemSubHeadingCode GrossWeight UnDangerousGoodsCode",
    ("Container", T.ArrayType(_record("ContainerNumber PackageQuantity"))),
    ("Package", _record("Marks KindOfPackage NumberOfPackages")),
    ("ProducedDocument", _record("DocumentType DocumentReference")),
)
DECLARATION = _record(
    "LocalReferenceNumber TotalNumberOfItems TotalNumberOfPackages CommercialRefNum TransportModeAtBorder",
    "IdeOfMeaOfTraCro ConveyanceRefNum PlaceOfLoading PlaceOfUnloading TotalGrossWeight",
    "TransportChargesMethodOfPayment DeclDateTime DeclPlace",
    ("Consignor", PARTY),
    ("Consignee", PARTY),
    ("NotifyParty", PARTY),
    ("LodgingPerson", _record("TIN")),
    ("Carrier", _record("TIN")),
    ("Itinerary", T.ArrayType(_record("CountryCode"))),
    ("GoodsItem", T.ArrayType(GOODS_ITEM)),
    ("CustOfficeOfFirstEntry", _record("RefNum ExpectedDateTimeOfArrival")),
    ("CustOfficeOfSubsequentEntry", T.ArrayType(_record("RefNum"))),
    ("Seal", T.ArrayType(_record("SealID ContainerNumber"))),
)
ENVELOPE = _record(("Interchange", INTERCHANGE), ("EntrySummaryDeclaration", DECLARATION))

_F10_ADDRESS = ("Address", _record("city country street postCode number"))
_UNLOCODE = _record("unlocode")
F10_PARTY = _record("name typeOfPerson", _F10_ADDRESS)
F10_GOODS_ITEM = _record(
    "goodsItemNumber",
    (
        "Commodity",
        _record(
            "descriptionOfGoods",
            ("CommodityCode", _record("harmonizedSystemSubHeadingCode")),
            ("DangerousGoods", _record("unNumber")),
        ),
    ),
    ("Weight", _record("grossMass")),
    ("Packaging", _record("shippingMarks numberOfPackages typeOfPackages")),
    (
        "TransportEquipment",
        T.ArrayType(
            _record(
                "containerSizeAndType containerPackedStatus containerSupplierType",
                "containerIdentificationNumber numberOfSeals",
                ("Seal", _record("identifier")),
            )
        ),
    ),
)
F10_BODY = _record(
    "LRN ConveyanceRefNum documentIssueDate specificCircumstanceIndicator reEntryIndicator",
    ("SplitConsignment", _record("splitConsignmentIndicator")),
    (
        "ActiveBorderTransportMeans",
        _record(
            "identificationNumber typeOfIdentification typeOfMeansOfTransport nationality modeOfTransport",
            "estimatedDateAndTimeOfDeparture estimatedDateAndTimeOfArrival",
            ("CountriesOfRoutingOfMeansOfTransport", T.ArrayType(_record("sequenceNumber country"))),
        ),
    ),
    (
        "ConsignmentMasterLevel",
        _record(
            ("Carrier", _record("name identificationNumber", _F10_ADDRESS)),
            (
                "ConsignmentHouseLevel",
                _record(
                    "containerIndicator totalGrossMass",
                    ("PlaceOfAcceptance", _UNLOCODE),
                    ("Consignee", F10_PARTY),
                    ("GoodsItem", T.ArrayType(F10_GOODS_ITEM)),
                    ("Consignor", F10_PARTY),
                    ("TransportCharges", _record("methodOfPayment")),
                    ("PlaceOfDelivery", _UNLOCODE),
                    ("GoodsShipment", _record(("Buyer", F10_PARTY), ("Seller", F10_PARTY))),
                ),
            ),
            ("PlaceOfLoading", _UNLOCODE),
            ("TransportDocumentMasterLevel", _record("documentNumber type")),
            ("PlaceOfUnloading", _UNLOCODE),
        ),
    ),
    (
        "Declarant",
        _record("name identificationNumber", _F10_ADDRESS, ("Communication", _record("identifier type"))),
    ),
    ("CustomsOfficeOfFirstEntry", _record("referenceNumber")),
    ("CustOfficeOfSubsequentEntry", T.ArrayType(_record("RefNum"))),
)
F10 = _record(("SMFAPI", _record("senderID recipientID docType")), ("SMFENS2FilingBody", F10_BODY))
F10_ENVELOPE = _record(("Body", _record(("SMFENS2", F10))))

CORRUPT = "_corrupt_record"


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The schema plus the column that takes a record which cannot be parsed."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


# --- fixed values: they have to be equal for equal results ---------------------------------------

PORT_OFFICES = {
    "CYLMS": "CY000510",
    "ITSAL": "IT084100",
    "ESCAS": "ES999811",
    "PTLEI": "PT000340",
    "GBLIV": "GB000080",
    "IEDUB": "IEDUB100",
    "BEANR": "BE101000",
    "FRMRS": "FR002730",
    "ESBCN": "ES000811",
    "ITGOA": "IT261101",
    "TRALI": "TR330100",
    "MACAS": "ES001211",
    "ITRAV": "IT081100",
    "ITVCE": "IT091100",
}

IMO_FLAGS = {
    "9354428": "PT",
    "9231834": "AG",
    "9242560": "AG",
    "9246530": "AG",
    "9242558": "AG",
    "9336294": "AG",
    "9436202": "PT",
    "9212034": "MH",
    "9212010": "MH",
    "9390824": "AG",
    "9429209": "FI",
    "9215311": "MH",
    "9246554": "AG",
    "9628180": "MT",
    "1016575": "PT",
    "1016563": "PT",
    "1016587": "PT",
}

# Routes in order of priority: the first one that lists a vessel is used.
# Vessels and ports of each route, ports and codes of the checklists, folders and offices.
ROUTE_VESSELS = {
    "WCUK": ["9242558", "9242560", "9246530", "9246554", "9354428"],
    "WM": ["9212010", "9212034", "9429209", "1016575", "1016563"],
    "ADR": ["9390824", "9336294"],
}

ROUTE_PORTS = {
    "WCUK": ["CYLMS", "TRALI", "ILHFA", "ILASH", "TRISK", "EGALY", "ITSAL", "ESCAS", "PTLEI", "GBLIV", "IEDUB", "BEANR"],
    "WM": ["CYLMS", "ILASH", "TRISK", "ILHFA", "EGALY", "TRALI", "ITSAL", "FRMRS", "ESBCN", "MACAS", "ESCAS", "ITGOA"],
    "ADR": ["FRMRS", "ESBCN", "ITGOA", "EGALY", "ILASH", "ILHFA", "CYLMS", "ITRAV", "ITVCE"],
}

CHECKLIST_SERVICE = "West Coast UK"
CHECKLIST_CODES = {
    "GBLIV": ["CYLMS", "ILHFA", "ILASH", "TRISK", "EGALY", "ITSAL", "ESCAS", "PTLEI"],
    "IEDUB": ["CYLMS", "ILHFA", "ILASH", "TRISK", "EGALY", "ITSAL", "ESCAS", "PTLEI", "GBLIV"],
}

GB_FOLDERS = ["CYLMS", "EGALY", "ILASH", "ILHFA", "ITSAL", "TRISK", "ESCAS", "PTLEI"]
GB_PORT = "GBLIV"
GB_PORT_ALIAS = "GBBEL"
GB_OFFICE = "GB000080"
GB_TAX_PORTS = ["GBLIV", "GBFXT"]

DEFAULT_CONTAINER_TYPE = "18"
MISSING_TARIFF = "000000"
NOT_AVAILABLE = "N/A"

DECLARATION_NAMESPACE = "http://www.ksdsoftware.com/Schema/ICS/EntrySummaryDeclaration"
