"""Invented declaration documents for file-based tests."""

from ensspark.schemas import DECLARATION_NAMESPACE as NS


def item(tariff="<TariffNumber>701912</TariffNumber>", containers=("ABCU0000001",), number="1", text="GLASS FIBRE"):
    boxes = "".join(f"<Container><ContainerNumber>{c}</ContainerNumber></Container>" for c in containers)
    item_number = f"<ItemNumber>{number}</ItemNumber>" if number else ""
    return (
        f"<GoodsItem>{item_number}<Description>{text}</Description>{tariff}<GrossWeight>7365</GrossWeight>{boxes}"
        "<Package><Marks>MK</Marks><KindOfPackage>CY</KindOfPackage><NumberOfPackages>5</NumberOfPackages></Package>"
        "<ProducedDocument><DocumentType>N705</DocumentType></ProducedDocument></GoodsItem>"
    )


def document(
    lrn="LRN1",
    imo="1016563",
    pol="EGALY",
    pou="ESBCN",
    office="IT084100",
    itinerary=("EG", "TR", "IT", "FR", "ES"),
    subsequent=("FR002730", "ES000811"),
    items=None,
    consignor_number="<number>4</number>",
    consignee_tag="Consignee",
    commercial="<CommercialRefNum>REF1</CommercialRefNum>",
    extra="",
    seals="<Seal><SealID>00123</SealID><ContainerNumber>ABCU0000001</ContainerNumber></Seal>",
):
    pou_tag = "" if pou is None else f"<PlaceOfUnloading>{pou}</PlaceOfUnloading>"
    goods = "".join([item()] if items is None else items)
    countries = "".join(f"<Itinerary><CountryCode>{c}</CountryCode></Itinerary>" for c in itinerary)
    offices = "".join(
        f"<CustOfficeOfSubsequentEntry><RefNum>{r}</RefNum></CustOfficeOfSubsequentEntry>" for r in subsequent
    )
    return f"""<?xml version="1.0" encoding="utf-8"?>
<Envelope xmlns="{NS}">
 <Interchange><Version>1</Version><SenderID>SENDER</SenderID><RecipientPwd>secret</RecipientPwd></Interchange>
 <EntrySummaryDeclaration>
  <LocalReferenceNumber>{lrn}</LocalReferenceNumber><TotalNumberOfItems>1</TotalNumberOfItems>{commercial}
  <IdeOfMeaOfTraCro>{imo}</IdeOfMeaOfTraCro><ConveyanceRefNum>V1</ConveyanceRefNum>
  <PlaceOfLoading>{pol}</PlaceOfLoading>{pou_tag}<TotalGrossWeight>9565</TotalGrossWeight>
  <TransportChargesMethodOfPayment>H</TransportChargesMethodOfPayment>
  <DeclDateTime>202512070000</DeclDateTime><DeclPlace>ITSAL</DeclPlace>
  <Consignor><Name>Açme Söhne Ltd</Name><Address>1  Dock Road</Address><Country>IL</Country><ZipCode>01234</ZipCode>
   <City>HAIFA</City>{consignor_number}</Consignor>
  <{consignee_tag}><Name>Beta S.A</Name><Address>2 Rue X</Address><Country>FR</Country><ZipCode>13002</ZipCode>
   <City>PARIS</City></{consignee_tag}>
  <LodgingPerson><TIN>XI1</TIN></LodgingPerson><Carrier><TIN>XI1</TIN></Carrier>
  {countries}{goods}
  <CustOfficeOfFirstEntry><RefNum>{office}</RefNum>
   <ExpectedDateTimeOfArrival>202512110000</ExpectedDateTimeOfArrival></CustOfficeOfFirstEntry>
  {offices}{seals}{extra}
 </EntrySummaryDeclaration>
</Envelope>
"""


def write(folder, name, text, bom=False):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8-sig" if bom else "utf-8")
