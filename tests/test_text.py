import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ensspark.functions import tariff, text, values


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, cleaned, removed",
    [
        ("Ã¼berÄ°ÅŸ", "uberIs", ""),
        ("Üsküdar Ñandú é", "Uskudar Nandu e", ""),
        ("A##B#$$C", "ABC", "#$"),
        ("O'Brien & (Co), No. 5/6-7", "O'Brien & (Co), No. 5/6-7", ""),
        ("Gıda №1", "Gda 1", "ı№"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_clean(spark, raw, cleaned, removed):
    assert one(spark, raw, text.clean) == cleaned
    assert one(spark, raw, text.removed_characters) == removed


def test_accent_only_text_is_not_rewritten(spark):
    assert one(spark, "Málaga", text.clean_if_dirty) == "Málaga"
    assert one(spark, "Málaga#", text.clean_if_dirty) == "Malaga"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=12), min_size=1, max_size=20))
def test_strip_accents_equals_decomposition(spark, words):
    got = spark.createDataFrame([(w,) for w in words], "x string").select(text.strip_accents(F.col("x")).alias("y"))
    want = ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.category(c).startswith("M")) for w in words]
    assert [r.y for r in got.collect()] == want


@pytest.mark.parametrize(
    "raw, normal",
    [
        ("A &amp; B", "A and B"),
        ("A&;B", "A and B"),
        ("O'Neil\n\n  x", "ONeil x"),
        ("a\nb", "a\nb"),
        ("1 &lt; 2", "1 &lt; 2"),
        ("<number>00</number>", "<number>N/A</number>"),
        ("<NotifyParty>x</NotifyParty>", "<Consignee>x</Consignee>"),
        ("a\u00a0\u00a0b", "a b"),
    ],
)
def test_normalize_document(spark, raw, normal):
    assert one(spark, raw, text.normalize_document) == normal


def test_specials_and_password(spark):
    assert one(spark, "a&b#c$d%e*f", text.strip_specials) == "abcdef"
    assert one(spark, "<a><RecipientPwd>x\ny</RecipientPwd></a>", text.redact_password) == "<a></a>"
    assert one(spark, '<a><x:recipientpwd y="1">secr', text.redact_password) == "<a>"
    assert one(spark, "<a><RecipientPwd/><b>x</b></a>", text.redact_password) == "<a><b>x</b></a>"


@pytest.mark.parametrize(
    "fn, raw, out",
    [
        (values.csv_to_list, " A, B ,,C", ["A", "B", "C"]),
        (values.csv_to_list, None, []),
        (values.vessel_code, r"\\host\ships\adga123", "ADGA"),
        (values.vessel_code, "/ships/Abcdef/", "ABCD"),
        (values.iso_date, "2026-02-30", None),
        (values.iso_date, "20260201", None),
        (values.compact_date, "20260201", True),
        (values.compact_date, "2026021", False),
        (lambda c: values.zulu(values.document_time(c)), "20251211 0630", "2025-12-11T06:30:00Z"),
        (lambda c: values.zulu(values.document_time(c)), "202513110630", None),
        (lambda c: values.relative_path(c, "/in/queue/"), "/in/queue/A/x.xml", "A/x.xml"),
        (lambda c: values.relative_path(c, "/in/queue"), "/out/x.xml", "/out/x.xml"),
        (lambda c: values.reference_or_fallback(c, F.lit("a.xml")), " ", "CommercialRefNum-NotFound-in-File-a.xml"),
        (lambda c: values.list_to_csv(values.csv_to_list(c)), "A, B", "A,B"),
        (values.country, "GBLIV", "GB"),
        (tariff.six_digits, "7019.12", True),
        (tariff.six_digits, "70191", False),
        (tariff.six_digits, "7019123", False),
        (tariff.six_digits, None, False),
        (tariff.scan_ok, " ", False),
        (tariff.scan_ok, "000000", True),
        (tariff.six_long, "7019.1", True),
        (tariff.six_long, "7019.12", False),
        (tariff.correction_ok, " 701912 ", True),
        (tariff.correction_ok, "7019.12", False),
    ],
)
def test_values(spark, fn, raw, out):
    assert one(spark, raw, fn) == out
