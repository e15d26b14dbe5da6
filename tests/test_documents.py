import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from ensspark import schemas, sinks
from ensspark.operators import f10, headers, routing, tariff, tracker
from ensspark.operators.headers import DECL
from ensspark.plans import catalog
from ensspark.sources import declarations as source
from ensspark.sources import settings
from ensspark.sources.lookups import imo_flags, port_offices, vessel_routes
from ensspark.streaming import entry_changes, queue
from tests.documents import document, item, write



def issued():
    return F.lit(dt.datetime(2025, 12, 1)).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ADGA123")
    write(root / "EGALY", "a.xml", document(lrn="A"), bom=True)
    write(
        root / "EGALY",
        "b 1.XML",
        document(lrn="B", pol="ILASH", pou="FRMRS", itinerary=("IL", "EG"), subsequent=("GB000080", "FR002730")),
    )
    write(root / "ESCAS", "a.xml", document(lrn="A2", consignee_tag="NotifyParty", consignor_number="<Number>00</Number>"))
    write(root / "ESCAS" / "deep", "c.xml", document(lrn="C", items=[item("", number=None), item("<TariffNumber>70191</TariffNumber>")]))
    write(root / "ESCAS", "broken.xml", "<Envelope><Interchange><RecipientPwd>secret</RecipientPwd></Inter")
    write(root / "OTHER", "d.xml", document(lrn="D", items=[], pou=None, commercial="<CommercialRefNum> </CommercialRefNum>"))
    write(root / "OTHER", "e.txt", "not xml")
    return root


@pytest.fixture(scope="module")
def docs(spark, folder):
    good, _ = source.split_corrupt(source.read_declarations(spark, str(folder)))
    return good.withColumn("doc", F.col(DECL)["LocalReferenceNumber"])


def convert(docs, spark, **kw):
    return f10.convert(docs, vessel_routes(spark), imo_flags(spark), issued(), **kw)


def by_doc(df):
    return {r.doc: r for r in df.collect()}


# --- sources ----------------------------------------------------------------------------------------


def test_read_is_recursive_and_keeps_broken_files(spark, folder):
    rows = source.read_declarations(spark, str(folder)).collect()
    assert sorted(r.file_name for r in rows) == ["a.xml", "a.xml", "b 1.XML", "broken.xml", "c.xml", "d.xml"]
    assert not any("secret" in str(r) for r in rows)
    flat = source.read_declarations(spark, str(folder / "ESCAS"), recursive=False)
    assert flat.count() == 2


def test_split_corrupt(spark, folder):
    good, bad = source.split_corrupt(source.read_declarations(spark, str(folder)))
    assert good.count() == 5
    assert [(r.file_name, r.stage) for r in bad.collect()] == [("broken.xml", "parse")]


def test_typed_values(docs):
    row = by_doc(docs)["A"]
    decl = row.EntrySummaryDeclaration
    assert (decl.Consignor.Number, decl.Consignor.ZipCode, decl.Seal[0].SealID) == ("4", "01234", "00123")
    assert [c.CountryCode for c in decl.Itinerary] == ["EG", "TR", "IT", "FR", "ES"]


def test_folders(spark, folder):
    kept = source.read_declarations(spark, str(folder), folders=["EGALY", "MISSING"])
    assert kept.count() == 2
    found = source.read_gb_candidates(spark, str(folder)).filter(F.col(schemas.CORRUPT).isNull())
    assert sorted((r.file_name, r.folder_pos) for r in found.collect()) == [("a.xml", 2), ("a.xml", 7), ("b 1.XML", 2)]
    last = headers.latest_by_file_name(found.select("file_name", "folder", "folder_pos"), "folder_pos")
    assert {(r.file_name, r.folder) for r in last.collect()} == {("a.xml", "ESCAS"), ("b 1.XML", "EGALY")}
    assert {f.split("/")[-2] for f in source.read_gb_candidates(spark, str(folder)).inputFiles()} == {"EGALY", "ESCAS"}
    none = source.read_gb_candidates(spark, str(folder), ["MISSING", "a{b,c}*"])
    assert none.collect() == [] and none.columns == found.columns


def test_text_read_kind_and_empty_tags(spark, folder):
    raw = source.read_documents(spark, str(folder))
    assert raw.filter(F.col("xml").contains("secret")).count() == 0
    kinds = {r.kind for r in source.with_kind(raw).collect()}
    assert kinds == {"Convert", None}
    parsed = source.parse_declarations(raw, normalize=True)
    empty = parsed.select("file_name", headers.empty_tag_in_text(F.col("xml"), F.col(schemas.CORRUPT)).alias("e"))
    found = {r.file_name: r.e for r in empty.collect()}
    assert found["d.xml"] is True and found["c.xml"] is False and found["broken.xml"] is None


def test_empty_tags_of_odd_texts(spark):
    inner = [
        "<b>x</b>", "<b> \t\n</b>", "<b/>", "<b />", "<b></b >", "<b c='>'/>", "<b c='&gt;/>'>x</b>", '<b c=">  ">x</b>', "<b><c>x</c> </b>",
        "<b><!-- x --></b>", "<b><![CDATA[ ]]></b>", "<b><![CDATA[</b>]]></b>", "<b>&#32;</b>", "<b>&#120;</b>", "<b><?p q?></b>", "x <b>\u00a0</b>",
        "<é>x</é>", "<é></é>", "<b c = 'd'\n e='f' ></b>", "<b>&amp;</b>", "",
    ]
    heads = ["", sinks.DECLARATION, "<?xml version='1.1'?>"]
    rows = [(f"{head}<a>{text}</a>",) for text in inner for head in heads]
    frame = spark.createDataFrame([*rows, (None,), ("",)], "xml string")
    fast = headers.empty_tag_in_text(F.col("xml"), F.lit(None).cast("string")).alias("fast")
    tree = F.xpath_boolean("xml", F.lit("//*[not(*) and normalize-space(.)='']")).alias("tree")
    got = frame.select("xml", fast, tree).collect()
    assert [r.xml for r in got if r.fast != r.tree] == []
    plan = frame.select(fast)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan


def test_vessel_code_lookup(spark, folder):
    codes = spark.createDataFrame([("adga", "9242558")], "code string, imo string")
    rows = source.read_documents(spark, str(folder))
    hit, missed = source.with_imo(rows, codes, F.lit(str(folder)))
    expected = folder.name[:4].upper() == "ADGA"
    assert (hit.count() > 0) == expected and (missed.count() == 0) == expected
    _, lost = source.with_imo(rows, codes, F.lit("/ships/ZZZZ1"))
    assert lost.first().reason == "no IMO for vessel code ZZZZ"


def test_settings(spark, tmp_path):
    good, broken = tmp_path / "settings.json", tmp_path / "broken.json"
    good.write_text(json.dumps({"port_mappings": {"A": "1", "B": "2"}}, indent=4))
    broken.write_text("{ not json")
    mapping = settings.read_mapping(spark, str(good))
    assert sorted(tuple(r) for r in mapping.collect()) == [("A", "1"), ("B", "2")]
    assert settings.read_mapping(spark, str(broken)).count() == 0
    assert settings.read_mapping(spark, str(tmp_path / "missing.json")).count() == 0
    settings.write_mapping(mapping, str(tmp_path / "out"))
    assert settings.read_mapping(spark, str(tmp_path / "out")).count() == 2


# --- routing and tariff ------------------------------------------------------------------------------


def test_route_repair_goldens(docs, spark):
    fixed = by_doc(f10.repair(docs, vessel_routes(spark)))
    assert fixed["A"].corrections == []
    b = fixed["B"]
    assert [c.CountryCode for c in b.EntrySummaryDeclaration.Itinerary] == ["IL", "TR", "IL", "EG", "TR", "IT", "FR"]
    assert [c.original_value for c in b.corrections] == ["IL, EG", "GB000080, FR002730"]
    assert [o.RefNum for o in b.EntrySummaryDeclaration.CustOfficeOfSubsequentEntry] == ["FR002730"]
    assert fixed["D"].corrections == []


@pytest.mark.parametrize(
    "imo, pou, status",
    [
        ("1016563", "GBLIV", "not_in_route"),
        ("9242558", None, "missing_pou"),
        ("9242558", "gbbel", "required"),
        ("9242558", "BEANR", "required"),
        ("9242558", "ITSAL", "not_required"),
        ("9242558", "FRMRS", "unknown_pou"),
        ("1", "GBLIV", "unknown_vessel"),
    ],
)
def test_gb_status(spark, imo, pou, status):
    row = spark.createDataFrame([(imo, pou)], "imo string, pou string")
    routed = routing.with_route(row, vessel_routes(spark), F.col("imo"))
    assert routed.select(routing.gb_status(F.col("ports"), F.col("pou")).alias("s")).first().s == status


def test_office_lookup_keeps_old_value(spark):
    row = spark.createDataFrame([("gbliv", "X"), ("ZZZZZ", "X")], "port string, ref_num string")
    found = routing.office_lookup(row, port_offices(spark), "port", old="ref_num")
    assert sorted(r.ref_num for r in found.collect()) == ["GB000080", "X"]


def test_nested_tariff(docs):
    goods = F.col(DECL)["GoodsItem"]
    rows = by_doc(docs.select("doc", tariff.document_valid(goods).alias("batch"), tariff.document_valid(goods, True).alias("scan")))
    assert (rows["A"].batch, rows["A"].scan) == (True, True)
    assert (rows["C"].batch, rows["C"].scan) == (False, False)
    assert (rows["D"].batch, rows["D"].scan) == (False, True)
    fixed = by_doc(docs.select("doc", tariff.correct_first_item(goods, F.lit("111111"))["TariffNumber"].alias("t")))
    assert fixed["C"].t == ["111111", "70191"] and fixed["A"].t == ["701912"]


# --- headers ---------------------------------------------------------------------------------------


def test_header_update(docs):
    updated = headers.update_headers(
        docs, F.lit("V9"), F.lit("9242558"), F.lit("gbliv"), F.lit("2026-01-02"), F.lit(""), "GBTIN", "XITIN"
    )
    row = by_doc(updated)["A"]
    decl = row.EntrySummaryDeclaration
    assert (decl.ConveyanceRefNum, decl.DeclPlace, decl.Carrier.TIN) == ("V9", "gbliv", "GBTIN")
    assert decl.CustOfficeOfFirstEntry.RefNum == "IT084100"
    assert decl.CustOfficeOfFirstEntry.ExpectedDateTimeOfArrival == "202601020000"
    assert (decl.Consignor.Number, decl.Consignee.Number, row.changed) == ("4", "N/A", True)
    refused = headers.update_headers(
        docs, F.lit("V9"), F.lit("1"), F.lit("X"), F.lit("2.1.2026"), F.lit(""), "GBTIN", "XITIN"
    )
    row = by_doc(refused)["A"]
    assert (row.error, row.changed) == ("Invalid date format: 2.1.2026", False)


def test_batch_update_skips_blanks_and_case(docs):
    same = {"DeclPlace": F.lit("itsal"), "ConveyanceRefNum": F.lit(" "), "IdeOfMeaOfTraCro": F.lit("1016563")}
    rows = by_doc(headers.batch_update(docs, same))
    decl = rows["A"].EntrySummaryDeclaration
    assert (decl.DeclPlace, decl.ConveyanceRefNum) == ("ITSAL", "V1")
    assert rows["C"].EntrySummaryDeclaration.GoodsItem[0].TariffNumber == "000000"
    assert (rows["A"].tariff_valid, rows["C"].tariff_valid) == (True, False)
    total = headers.batch_summary(headers.batch_update(docs, same)).first()
    assert (total.documents, total.errors) == (5, 0)


def test_gb_rewrite(docs):
    rows = by_doc(
        headers.gb_rewrite(docs, F.lit("9242558"), F.lit("V001E"), F.lit("20240815"), "GBTIN", itinerary=F.array(F.lit("GB")))
    )
    decl = rows["C"].EntrySummaryDeclaration
    assert [g.ItemNumber for g in decl.GoodsItem] == [None, "1"] and decl.TotalNumberOfItems == "1"
    assert [c.CountryCode for c in decl.Itinerary] == ["GB"]
    assert (decl.DeclPlace, decl.CustOfficeOfFirstEntry.RefNum, decl.Carrier.TIN) == ("GBLIV", "GB000080", "GBTIN")
    assert rows["D"].queue == "GB-Filings/Problematic" and rows["A"].queue == "GB-Filings"


# --- conversion ------------------------------------------------------------------------------------


def test_conversion(docs, spark):
    types = spark.createDataFrame([("abcu0000001", "22G1")], "container string, size_type string")
    codes = spark.createDataFrame([("glass fibre", "701990")], "description string, code string")
    rows = by_doc(convert(docs, spark, container_types=types, hs_codes=codes))
    body = rows["A"].F10.SMFENS2FilingBody
    means, house = body.ActiveBorderTransportMeans, body.ConsignmentMasterLevel.ConsignmentHouseLevel
    assert (body.LRN, rows["A"].f10_name, means.identificationNumber, means.nationality) == ("A", "A_F10", "IMO1016563", "PT")
    assert means.estimatedDateAndTimeOfDeparture == "2025-12-04T00:00:00Z"
    assert means.estimatedDateAndTimeOfArrival == "2025-12-11T00:00:00Z"
    assert [c.country for c in means.CountriesOfRoutingOfMeansOfTransport] == ["EG", "TR", "IT", "FR", "ES"]
    assert (house.Consignor.name, house.Consignor.Address.street) == ("Acme Sohne Ltd", "1 Dock Road")
    assert (house.Consignee.Address.number, house.GoodsShipment.Buyer.name) == ("N/A", "Beta S.A")
    box = house.GoodsItem[0].TransportEquipment[0]
    assert (box.containerSizeAndType, box.numberOfSeals, box.Seal.identifier) == ("22G1", "1", "00123")
    other = rows["A2"].F10.SMFENS2FilingBody.ConsignmentMasterLevel.ConsignmentHouseLevel
    assert other.Consignee.name == "Beta S.A" and other.Consignor.Address.number == "N/A"
    assert rows["C"].reject_reason == "Failed HS Code Check" and rows["C"].F10 is None
    assert rows["B"].F10.SMFENS2FilingBody.CustOfficeOfSubsequentEntry[0].RefNum == "FR002730"
    assert rows["D"].reject_reason is None


def test_seals(spark, tmp_path):
    seals = (
        "<Seal><SealID></SealID><ContainerNumber>C1</ContainerNumber></Seal>"
        "<Seal><SealID>S1</SealID><ContainerNumber>C1</ContainerNumber></Seal>"
        "<Seal><SealID>S2</SealID><ContainerNumber>c1</ContainerNumber></Seal><Seal><SealID>S3</SealID></Seal>"
    )
    write(tmp_path, "s.xml", document(items=[item(containers=("C1", "C2"))], seals=seals))
    docs = source.read_declarations(spark, str(tmp_path)).withColumn("doc", F.lit("S"))
    goods = convert(docs, spark).first().F10.SMFENS2FilingBody.ConsignmentMasterLevel.ConsignmentHouseLevel.GoodsItem
    found = [(b.containerSizeAndType, b.numberOfSeals, b.Seal.identifier) for b in goods[0].TransportEquipment]
    assert found == [("18", "1", "S1"), ("18", "0", "None")]


def test_party_warnings(docs):
    party = F.col(DECL)["Consignor"].withField("City", F.lit(""))
    rows = docs.select(f10.party_warnings(party, "Consignor").alias("w")).first().w
    assert rows == ["Consignor City is missing or empty"]


def test_f10_text_is_detected_and_cleaned(docs, spark):
    done = convert(docs, spark).filter("doc = 'A'")
    dirty = done.withColumn("F10", F.col("F10").withField(
        "SMFENS2FilingBody.ConsignmentMasterLevel.ConsignmentHouseLevel.Consignee.name", F.lit("Bétä #1")))
    written = dirty.select("doc", sinks.f10_xml(F.col("F10")).alias("xml"))
    parsed = source.parse_filings(source.with_kind(written))
    row = parsed.withColumn("F10", headers.clean_f10(F.col("F10"))).first()
    house = row.F10.SMFENS2FilingBody.ConsignmentMasterLevel.ConsignmentHouseLevel
    assert row.kind == "F10" and house.Consignee.name == "Beta 1" and house.Consignor.name == "Acme Sohne Ltd"
    assert "<unNumber/>" in row.xml.replace(" ", "") or "<unNumber></unNumber>" in row.xml


def test_declaration_files_are_small_and_read_back(docs, spark, tmp_path):
    many = docs.crossJoin(spark.range(50).select("id")).coalesce(1)
    sinks.write_declaration_files(many, str(tmp_path / "ships" / "CYLM"))
    files = [p for p in (tmp_path / "ships" / "CYLM").iterdir() if p.name.startswith("part-")]
    texts = source.read_documents(spark, str(tmp_path / "ships")).collect()
    plain = sum(len(r.xml) for r in texts)
    assert sum(p.stat().st_size for p in files) * 5 < plain
    assert {r.file_name for r in texts} == {p.name.removesuffix(".gz") for p in files}
    good, broken = source.split_corrupt(source.read_declarations(spark, str(tmp_path / "ships")))
    reference = F.col(DECL)["LocalReferenceNumber"]
    assert sorted(good.groupBy(reference).count().collect()) == sorted(many.groupBy(reference).count().collect())
    assert good.count() == many.count() and broken.count() == 0


def test_declaration_files_are_bounded(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_DOCUMENTS", 20)
    sinks.write_declaration_files(docs.limit(1).crossJoin(spark.range(50).select("id")).coalesce(1), str(tmp_path / "out"))
    texts = source.read_documents(spark, str(tmp_path / "out")).collect()
    assert sorted(r.xml.count("<LocalReferenceNumber>") for r in texts) == [10, 20, 20]


# --- sinks and streams --------------------------------------------------------------------------------


def test_sinks(docs, spark, tmp_path):
    done = convert(docs, spark)
    sinks.write_filings(done, str(tmp_path / "filings"))
    assert spark.read.parquet(str(tmp_path / "filings")).count() == 4
    routed = done.select("doc", sinks.conversion_queue().alias("queue"))
    sinks.write_queues(routed, str(tmp_path / "queues"))
    back = spark.read.parquet(str(tmp_path / "queues"))
    assert {r.queue: r["count"] for r in back.groupBy("queue").count().collect()} == {"Upload": 4, "HSCode_Failed": 1}
    audit = routing.correction_audit(done, "doc")
    sinks.write_audit(audit, str(tmp_path / "audit"))
    sinks.write_audit(audit, str(tmp_path / "audit"))
    # B: itinerary and offices; nothing else differs from its route.
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2 * audit.count() > 0
    refused = done.filter("reject_reason IS NOT NULL")
    sinks.write_rejects(source.rejects(refused, "convert", F.col("reject_reason")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().reason == "Failed HS Code Check"
    report = spark.createDataFrame([("R1",), ("R2",)], "reference string")
    sinks.write_report(report, str(tmp_path / "report"))
    sinks.write_report(report.limit(1), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 1
    changed = headers.batch_update(docs, {"DeclPlace": F.lit("GBLIV")})
    sinks.write_declarations(changed, str(tmp_path / "rewritten"))
    again = source.parse_declarations(spark.read.parquet(str(tmp_path / "rewritten")))
    assert again.filter(F.col(DECL)["DeclPlace"] == "GBLIV").count() == 5


def test_export_csv(spark, tmp_path):
    details = spark.createDataFrame(
        [("Alpha", "V1", None, "GBLIV", dt.date(2026, 1, 1), True, "A,B")],
        "vessel_name string, voyage_number string, service_name string, port string, arrival_date date, is_declared boolean, uploaded_files string",
    )
    sinks.write_export(details, str(tmp_path / "csv"))
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (row.Vessel, row.Declared, row.Files) == ("Alpha", "Yes", "A,B")


def test_queue_converts_new_files_once(spark, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "a.xml", document(lrn="A"))
    write(inbox, "bad.xml", "<Envelope><oops")

    def run():
        stream = queue.read_queue(spark, str(inbox))
        queue.convert_queue(
            stream, str(tmp_path / "out"), str(tmp_path / "cp"),
            routes=vessel_routes(spark), flags=imo_flags(spark), issued=issued(),
        ).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).select("file_name", "queue").collect()
        return sorted(tuple(r) for r in rows)

    assert run() == [("a.xml", "Upload"), ("bad.xml", "Failed")]
    write(inbox, "b.xml", document(lrn="B", items=[item("")]))
    assert run() == [("a.xml", "Upload"), ("b.xml", "HSCode_Failed"), ("bad.xml", "Failed")]


def test_queue_of_texts_gives_every_file_a_row(docs, spark, tmp_path):
    inbox = tmp_path / "in"
    filing = convert(docs, spark).filter("doc = 'A'").select(sinks.f10_xml(F.col("F10")).alias("xml")).first().xml
    write(inbox, "a.xml", document(lrn="SAME"))
    write(inbox, "b.xml", document(lrn="SAME", consignor_number=""))
    write(inbox, "c.xml", document(lrn="C", items=[item("")]))
    write(inbox, "ready.XML", filing)
    write(inbox, "bad.xml", document(lrn="CUT")[:400])
    write(inbox, "other.xml", "<Invoice><Total>1</Total></Invoice>")
    queue.convert_queue(
        queue.read_texts(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "cp"),
        routes=vessel_routes(spark), flags=imo_flags(spark), issued=issued(),
        container_types=spark.createDataFrame([("abcu0000001", "22G1")], "container string, size_type string"),
    ).awaitTermination()
    rows = {r.file_name: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {n: (r.queue, r.reason) for n, r in rows.items()} == {
        "a.xml": ("Upload", None),
        "b.xml": ("Upload", None),
        "c.xml": ("HSCode_Failed", "Failed HS Code Check"),
        "ready.XML": ("Upload", None),
        "bad.xml": ("Failed", "not well-formed"),
        "other.xml": ("Failed", "no declaration"),
    }
    assert rows["ready.XML"].f10_name == "ready" and "<LRN>A</LRN>" in rows["ready.XML"].xml
    assert "secret" not in "".join(str(r) for r in rows.values())


def test_hot_keys_are_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        # so few rows would be written by one task, whose output cannot be split
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    rows = spark.range(0, 60_000, 1, 8).withColumn("hot", F.when(F.col("id") % 10 < 7, 7).otherwise(F.col("id")))
    entries = rows.select("id", F.col("hot").alias("voyage_id"), F.lit("GBLIV").alias("port"), F.expr("date_add(DATE'2026-01-01', int(id % 90))").alias("arrival_date"))
    words = F.concat(F.lit("WORD "), F.col("hot"))
    items = rows.select(F.col("id").alias("doc"), F.lit(1).alias("pos"), words.alias("description"), F.lit(None).cast("string").alias("harmonized"), F.lit(None).cast("string").alias("tariff"))
    codes = rows.select(words.alias("description"), F.lit("701912").alias("code"))
    boxes = rows.select(F.col("id").alias("doc"), F.lit(1).alias("pos"), words.alias("container"))
    types = rows.select(words.alias("container"), F.lit("22G1").alias("size_type"))
    seals = boxes.select("doc", "pos", F.lit("S").alias("seal"), "container")
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for df in (tracker.arrival_offsets(entries), f10.resolve_hs(items, codes), f10.equipment(boxes, seals, types)):
            assert len(df.collect()) == 60_000
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_folded_changes_merge_in_any_split(spark):
    entries = spark.createDataFrame([(1, 1, "A", dt.date(2026, 1, 1), False, "F"), (2, 1, "B", dt.date(2026, 1, 2), False, None)], schemas.ENTRIES)
    columns = "seq long, entry_id long, kind string, is_declared boolean, port string, arrival_date date, uploaded_files string"
    day = dt.date(2026, 2, 1)
    rows = [
        (1, 1, "edit", None, "X", day, "G"),
        (2, 1, "status", True, None, None, None),
        (3, 1, "edit", None, "Y", day, None),
        (4, 2, "delete", None, None, None, None),
        (5, 1, "status", False, None, None, None),
    ]
    first = entry_changes.fold(spark.createDataFrame(rows[:2], columns))
    second = entry_changes.fold(spark.createDataFrame(rows[2:], columns))
    out = entry_changes.current(entries, second.unionByName(first)).collect()
    assert [tuple(r) for r in out] == [(1, 1, "Y", day, False, "G")]


def test_a_document_of_20000_containers(spark):
    """Containers and seals are matched by one map per document; the first usable seal of a container wins."""
    n = 20_000
    boxes = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.format_string("abcu%07d", i).alias("ContainerNumber"), F.lit("1").alias("PackageQuantity")))
    seals = F.transform(
        F.sequence(F.lit(2 * n), F.lit(1), F.lit(-1)),  # two seals for each container, the later ones first
        lambda i: F.struct(
            F.when(i % 5 == 0, "").otherwise(F.format_string("S%d", i)).alias("SealID"),
            F.when(i % 7 != 0, F.format_string("ABCU%07d", F.floor((i + 1) / 2))).alias("ContainerNumber"),
        ),
    )
    goods = F.struct(F.lit("x").alias("Description"), F.lit("701912").alias("TariffNumber"), boxes.alias("Container"))
    declaration = F.struct(F.array(goods).alias("GoodsItem"), seals.alias("Seal"))
    docs = spark.range(1).select(F.lit("big").alias("doc"), F.from_json(F.to_json(declaration), schemas.DECLARATION).alias(DECL))
    started = time.time()
    found = {r.container: r.seal for r in f10.flatten_goods(docs).collect()}
    usable = {i: f"S{i}" for i in range(1, 2 * n + 1) if i % 5 and i % 7}
    assert found == {f"abcu{c:07d}": usable.get(2 * c) or usable.get(2 * c - 1) for c in range(1, n + 1)}
    assert time.time() - started < 60


def test_lookups_share_one_pass(docs, spark):
    types = spark.createDataFrame([("abcu0000001", "22G1"), ("ABCU0000001", "45G1")], "container string, size_type string")
    codes = spark.createDataFrame([("glass fibre", "701912")], "description string, code string")
    plain, both = convert(docs, spark), convert(docs, spark, container_types=types, hs_codes=codes)
    row = by_doc(both)
    assert row["A"].F10.SMFENS2FilingBody.ConsignmentMasterLevel.ConsignmentHouseLevel.GoodsItem[0].TransportEquipment[0].containerSizeAndType == "22G1"
    assert row["C"].item_hs == ["701912", "70191"] and by_doc(plain)["C"].item_hs == [None, "70191"]

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(both) - joins(plain) == 2  # keys with answers, answers with documents


def _plan(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_documents_are_not_sorted_for_their_lookups(spark, docs):
    types = spark.createDataFrame([("ABCU0000001", "22")], "container string, size_type string")
    done = convert(docs, spark, container_types=types)
    assert "ShuffledHashJoin" in _plan(done) and "SortMergeJoin" not in _plan(done)
    sizes = F.transform("F10.SMFENS2FilingBody.ConsignmentMasterLevel.ConsignmentHouseLevel.GoodsItem", lambda g: g["TransportEquipment"]["containerSizeAndType"])
    assert {r.s for r in done.select(F.explode(F.flatten(sizes)).alias("s")).collect()} == {"22"}


def test_conversion_without_rejects(spark, docs):
    """The same filings, and of a filing only the parts that somebody reads."""
    both, accepted = convert(docs, spark), convert(docs, spark, rejects=False)
    wanted = both.filter("reject_reason IS NULL").select("f10_name", "F10").collect()
    assert 0 < len(wanted) < both.count()
    assert sorted(map(str, accepted.select("f10_name", "F10").collect())) == sorted(map(str, wanted))
    offices = "F10.SMFENS2FilingBody.CustOfficeOfSubsequentEntry"
    assert "ConveyanceRefNum, ," not in _plan(accepted.select(offices), "optimizedPlan")
    assert "ConveyanceRefNum, ," in _plan(both.filter("reject_reason IS NULL").select("F10"), "optimizedPlan")


def test_filing_is_parsed_once_for_kind_and_values(spark, docs):
    written = convert(docs, spark).filter("F10 IS NOT NULL").select("f10_name", sinks.f10_xml(F.col("F10")).alias("xml"))
    apart = source.parse_filings(source.with_kind(written))
    once = source.parse_filings(source.with_kind(written, keep="filing"), parsed="filing")
    assert once.columns == apart.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
    assert _plan(once, "optimizedPlan").count("from_xml") == 1


def test_values_with_nothing_to_repair_stay(spark):
    """One search tells clean values; values to repair keep the order of the rules, also where one makes room for the next."""
    cases = {"a  b": "a b", "a&;b": "a and b", "a &b": "a and b", "it's": "its", "a' 'b": "a b", "\t x": " x", " ": " ", "": "", "a\nb": "a\nb", "x  y": "x y", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", f10.normalize_value(F.col("v")).alias("n"))
    assert {r.v: r.n for r in rows.collect()} == cases
    assert "rlike" in _plan(rows, "optimizedPlan").lower()


@pytest.mark.parametrize("hot", [7, None])
def test_documents_of_one_key_are_spread(spark, tmp_path, hot):
    """A third of the orders share a key, or have none: no task builds, writes and parses all of their documents."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id"))
    orders = spark.range(0, 600, 1, 2).select(
        key.alias("o_orderkey"), F.lit(5).cast("long").alias("o_custkey"), F.lit(dt.datetime(1995, 3, 1)).alias("o_orderdate")
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        # fewer than the cores, of which none may idle
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        docs = catalog.QUERIES["xml_roundtrip"](spark, str(tmp_path))
        tasks = [r["count"] for r in docs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert docs.filter("doc IS NOT DISTINCT FROM " + ("7" if hot else "NULL")).count() == 200 + bool(hot)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cores = spark.sparkContext.defaultParallelism
    assert sum(tasks) == 600 and len(tasks) == cores and max(tasks) <= 1.2 * 600 / cores + 2
