"""Text, routing, tariff and header queries over derived declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.functions import text as tx
from ensspark.functions.values import reference_or_fallback
from ensspark.operators import routing, tariff
from ensspark.plans import declarations as decl
from ensspark.plans.declarations import DOCS_SQL, FLAT_SQL, OFFICES_SQL, ROUTES_SQL
from ensspark.plans.registry import query
from ensspark.plans.standin import TRACKER_SQL, entries, table
from ensspark.sources.lookups import port_offices, vessel_routes

# --- text -----------------------------------------------------------------------------------------

_REPAIRED = "text"
for _garbled, _letter in (
    ("Ãœ", "U"), ("Ã¼", "u"), ("Ä°", "I"), ("Ä±", "i"), ("Åž", "S"), ("ÅŸ", "s"),
    ("Ã‡", "C"), ("Ã§", "c"), ("Ã–", "O"), ("Ã¶", "o"), ("Äž", "G"), ("ÄŸ", "g"),
):
    _REPAIRED = f"replace({_REPAIRED}, '{_garbled}', '{_letter}')"
PLAIN_SQL = f"regexp_replace(strip_accents({_REPAIRED}), '\\p{{M}}', '', 'g')"
BAD = "[^a-zA-Z0-9 /.,''&()-]"


@query(
    "clean_text",
    f"SELECT doc_id, regexp_replace({PLAIN_SQL}, '{BAD}', '', 'g') AS cleaned FROM documents",
)
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(
    "removed_chars",
    f"""WITH found AS (SELECT doc_id, regexp_extract_all({PLAIN_SQL}, '{BAD}') AS f FROM documents)
      SELECT doc_id, array_to_string(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), '') AS removed FROM found""",
)
def removed_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.removed_characters(F.col("text")).alias("removed"))


_NORMAL = "html"
for _old, _new in (
    ("&lt;", ""), ("&gt;", ""), ("&apos;", "''"), ("&quot;", '"'), ("&amp;", "&"), ("&;", " and "),
    ("''", ""), ("&", " and "), ("", "&lt;"), ("", "&gt;"),
):
    _NORMAL = f"replace({_NORMAL}, '{_old}', '{_new}')"
_NORMAL = f"regexp_replace({_NORMAL}, '[\\s\\v\\x{{85}}\\p{{Z}}]{{2,}}', ' ', 'g')"


@query("normalize_text", f"SELECT page_id, {_NORMAL} AS normalized FROM pages")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_document(F.col("html")).alias("normalized"))


@query(
    "strip_specials",
    "SELECT doc_id, regexp_replace(text, '[&#$%*]', '', 'g') AS stripped FROM documents",
)
def strip_specials(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_specials(F.col("text")).alias("stripped"))


# --- routing --------------------------------------------------------------------------------------

REPAIR_SQL = f"""{DOCS_SQL}, {ROUTES_SQL}, {OFFICES_SQL},
placed AS (
  SELECT d.*, l.itinerary, l.offices, r.ports, list_position(r.ports, d.pol) AS s, list_position(r.ports, d.pou) AS e,
    list_position(r.ports, o.port) AS f, o.port AS first_port
  FROM docs d JOIN lists l ON l.k = d.k LEFT JOIN routes r ON r.imo = d.imo LEFT JOIN office_of o ON o.ref_num = d.office),
repaired AS (
  SELECT *, CASE WHEN s > 0 AND e > s THEN list_transform(ports[s:e], lambda p: substr(p, 1, 2)) END AS right_itinerary,
    CASE WHEN s > 0 AND e > s AND first_port IS NOT NULL THEN CASE WHEN f > 0 AND e > f THEN
      list_filter(list_transform(ports[f + 1:e], lambda p: map_extract(MAP {{{', '.join(f"'{p}': '{o}'" for p, o in decl.PORT_OFFICES.items())}}}, p)[1]),
        lambda x: x IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END END AS right_offices FROM placed),
texts AS (
  SELECT *, array_to_string(list_transform(itinerary, lambda x: trim(x)), ', ') AS old_it, array_to_string(right_itinerary, ', ') AS new_it,
    array_to_string(offices, ', ') AS old_of, array_to_string(right_offices, ', ') AS new_of FROM repaired),
flagged AS (SELECT *, coalesce(new_it <> old_it, FALSE) AS it_changed, coalesce(new_of <> old_of, FALSE) AS of_changed FROM texts)"""


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decl.documents(spark, sf_dir).select("doc", "EntrySummaryDeclaration.*")
    routed = routing.with_route(docs, vessel_routes(spark), F.col("IdeOfMeaOfTraCro"))
    return routing.repair_routes(
        routed,
        ports=F.col("ports"),
        pol=F.col("PlaceOfLoading"),
        pou=F.col("PlaceOfUnloading"),
        first_office=F.col("CustOfficeOfFirstEntry.RefNum"),
        itinerary=F.col("Itinerary.CountryCode"),
        offices=F.col("CustOfficeOfSubsequentEntry.RefNum"),
    )


@query(
    "itinerary_repair",
    f"""WITH {REPAIR_SQL} SELECT k AS doc, CASE WHEN it_changed THEN new_it ELSE old_it END AS itinerary,
      it_changed AS changed FROM flagged""",
)
def itinerary_repair(spark, sf_dir):
    return _repaired(spark, sf_dir).select(
        "doc",
        routing.joined(F.col("new_itinerary")).alias("itinerary"),
        F.exists("corrections", lambda c: c["element_path"] == routing.ITINERARY_PATH).alias("changed"),
    )


@query(
    "office_repair",
    f"""WITH {REPAIR_SQL} SELECT k AS doc, CASE WHEN of_changed THEN new_of ELSE old_of END AS offices,
      of_changed AS changed FROM flagged""",
)
def office_repair(spark, sf_dir):
    return _repaired(spark, sf_dir).select(
        "doc",
        routing.joined(F.col("new_offices")).alias("offices"),
        F.exists("corrections", lambda c: c["element_path"] == routing.OFFICES_PATH).alias("changed"),
    )


@query(
    "correction_audit",
    f"""WITH {REPAIR_SQL}
      SELECT k AS doc, 'Itinerary Section' AS element_path, old_it AS original_value, new_it AS corrected_value,
        'Rebuilt Itinerary with 2-letter country codes based on vessel route.' AS reason FROM flagged WHERE it_changed
      UNION ALL SELECT k, 'CustOfficeOfSubsequentEntry Section', old_of, new_of,
        'Rebuilt Subsequent Entries based on vessel route.' FROM flagged WHERE of_changed""",
)
def correction_audit(spark, sf_dir):
    return routing.correction_audit(_repaired(spark, sf_dir), "doc")


@query(
    "correction_counts",
    f"""WITH {REPAIR_SQL} SELECT CAST(it_changed AS INTEGER) + CAST(of_changed AS INTEGER) AS corrections,
      count(*) AS documents FROM flagged GROUP BY 1""",
)
def correction_counts(spark, sf_dir):
    sized = _repaired(spark, sf_dir).withColumn("n", F.size("corrections"))
    return sized.groupBy(F.col("n").alias("corrections")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "gb_filing",
    f"""WITH {DOCS_SQL}, {ROUTES_SQL}, placed AS (SELECT k, pou, ports,
        coalesce(list_position(ports, 'GBLIV'), 0) AS gb,
        coalesce(list_position(ports, CASE WHEN pou = 'GBBEL' THEN 'GBLIV' ELSE pou END), 0) AS pos
        FROM docs LEFT JOIN routes ON routes.imo = docs.imo)
      SELECT k AS doc, CASE WHEN ports IS NULL THEN 'unknown_vessel' WHEN coalesce(pou, '') = '' THEN 'missing_pou'
        WHEN gb = 0 THEN 'not_in_route' WHEN pos = 0 THEN 'unknown_pou' WHEN pos >= gb THEN 'required'
        ELSE 'not_required' END AS status FROM placed""",
)
def gb_filing(spark, sf_dir):
    docs = decl.documents(spark, sf_dir).select("doc", "EntrySummaryDeclaration.*")
    routed = routing.with_route(docs, vessel_routes(spark), F.col("IdeOfMeaOfTraCro"))
    return routed.select("doc", routing.gb_status(F.col("ports"), F.col("PlaceOfUnloading")).alias("status"))


@query(
    "office_lookup",
    f"""WITH {TRACKER_SQL}, {OFFICES_SQL} SELECT id AS entry_id, entries.port, coalesce(ref_num, '') AS ref_num
      FROM entries LEFT JOIN office_of ON office_of.port = entries.port""",
)
def office_lookup(spark, sf_dir):
    rows = entries(spark, sf_dir).select(F.col("id").alias("entry_id"), "port")
    return routing.office_lookup(rows, port_offices(spark), "port")


# --- tariff over flat goods items -------------------------------------------------------------------

ITEM_SQL = f"""{FLAT_SQL}, coded AS (SELECT *, coalesce(tariff, harmonized) AS code FROM flat_items),
judged AS (SELECT *, coalesce(length(regexp_replace(code, '[^0-9]', '', 'g')) = 6, FALSE) AS ok FROM coded),
verdicts AS (
  SELECT o_orderkey AS doc, coalesce(items, 0) AS items, coalesce(failed_items, 0) AS failed_items,
    CASE WHEN o_orderkey % 13 = 0 THEN 'CommercialRefNum-NotFound-in-File-D' || o_orderkey || '.xml'
      WHEN o_orderkey % 2 = 0 THEN 'CR' || (o_orderkey // 4) ELSE 'cr' || (o_orderkey // 4) END AS reference
  FROM orders LEFT JOIN (SELECT doc, count(*) AS items, count(*) FILTER (NOT ok) AS failed_items FROM judged GROUP BY doc) t
    ON t.doc = o_orderkey)"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = F.floor(key / 4)
    given = F.when(key % 13 == 0, " ").when(key % 2 == 0, decl.join("CR", number)).otherwise(decl.join("cr", number))
    return table(spark, sf_dir, "orders").select(
        key.alias("doc"), reference_or_fallback(given, decl.join("D", key, ".xml")).alias("reference")
    )


def _verdicts(spark: SparkSession, sf_dir: str, scan: bool = False) -> DataFrame:
    return tariff.check_documents(_references(spark, sf_dir), decl.goods_items(spark, sf_dir), scan)


@query(
    "tariff_validate",
    f"""WITH {ITEM_SQL} SELECT doc, reference, items, failed_items, items > 0 AND failed_items = 0 AS valid FROM verdicts""",
)
def tariff_validate(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(
    "tariff_scan",
    f"""WITH {ITEM_SQL} SELECT doc, reference, items, failed_items, failed_items = 0 AS valid FROM verdicts""",
)
def tariff_scan(spark, sf_dir):
    return _verdicts(spark, sf_dir, scan=True)


@query(
    "tariff_summary",
    f"""WITH {ITEM_SQL}, v AS (SELECT *, items > 0 AND failed_items = 0 AS valid FROM verdicts)
      SELECT count(*) FILTER (valid) AS valid_documents, count(*) AS documents,
        count(DISTINCT lower(reference)) FILTER (NOT valid) AS failed_references FROM v""",
)
def tariff_summary(spark, sf_dir):
    return tariff.summary(_verdicts(spark, sf_dir))


@query(
    "tariff_report",
    f"""WITH {ITEM_SQL} SELECT min(reference) AS reference FROM verdicts
      WHERE items = 0 OR failed_items > 0 GROUP BY lower(reference)""",
)
def tariff_report(spark, sf_dir):
    return tariff.failed_references(_verdicts(spark, sf_dir))


ISSUES_SQL = """issues AS (
  SELECT doc, pos, coalesce(item_number, CAST(pos AS VARCHAR)) AS item_number,
    coalesce(description, '(Not Found)') AS description, coalesce(code, '(Missing)') AS current_value
  FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM judged WHERE NOT ok) WHERE n = 1)"""


@query("tariff_first_issue", f"WITH {ITEM_SQL}, {ISSUES_SQL} SELECT * FROM issues")
def tariff_first_issue(spark, sf_dir):
    return tariff.first_issues(decl.goods_items(spark, sf_dir))


@query(
    "tariff_default",
    f"""WITH {ITEM_SQL} SELECT doc, pos, item_number, description, coalesce(code, '000000') AS code,
      code IS NULL AS tariff_defaulted FROM judged""",
)
def tariff_default(spark, sf_dir):
    filled = tariff.default_missing(decl.goods_items(spark, sf_dir))
    return filled.select("doc", "pos", "item_number", "description", tariff.code().alias("code"), "tariff_defaulted")


@query(
    "tariff_correct",
    f"""WITH {ITEM_SQL}, {ISSUES_SQL}, fixes AS (SELECT o_orderkey AS doc,
        lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS new_code FROM orders WHERE o_orderkey % 8 <> 0)
      SELECT j.doc, j.pos, coalesce(f.new_code, j.tariff) AS tariff,
        CASE WHEN f.new_code IS NULL THEN j.harmonized END AS harmonized
      FROM judged j LEFT JOIN issues i ON i.doc = j.doc AND i.pos = j.pos LEFT JOIN fixes f ON f.doc = i.doc""",
)
def tariff_correct(spark, sf_dir):
    key = F.col("o_orderkey")
    typed = F.when(key % 8 == 0, "12345").otherwise(decl.join(" ", decl.digits(key % 1000000, 6)))
    fixes = table(spark, sf_dir, "orders").select(key.alias("doc"), typed.alias("code"))
    fixed = tariff.correct_first_issue(decl.goods_items(spark, sf_dir), fixes)
    return fixed.select("doc", "pos", "tariff", "harmonized")


@query(
    "tariff_nested",
    f"""WITH {DOCS_SQL}, judged AS (SELECT k, coalesce(length(regexp_replace(coalesce(tariff, harmonized), '[^0-9]', '', 'g')) = 6, FALSE) AS ok
        FROM goods), tally AS (SELECT k, bool_and(ok) AS all_ok FROM judged GROUP BY k)
      SELECT docs.k AS doc, coalesce(all_ok, FALSE) AS valid, coalesce(all_ok, TRUE) AS scan_valid
      FROM docs LEFT JOIN tally ON tally.k = docs.k""",
)
def tariff_nested(spark, sf_dir):
    """The same rules over documents that hold their items in the row."""
    goods = F.col("EntrySummaryDeclaration.GoodsItem")
    return decl.documents(spark, sf_dir).select(
        "doc",
        tariff.document_valid(goods).alias("valid"),
        tariff.document_valid(goods, scan=True).alias("scan_valid"),
    )


@query(
    "tariff_nested_fix",
    f"""WITH {DOCS_SQL}, coded AS (SELECT *, coalesce(tariff, harmonized) AS code FROM goods),
      judged AS (SELECT *, coalesce(length(regexp_replace(code, '[^0-9]', '', 'g')) = 6, FALSE) AS ok FROM coded),
      firsts AS (SELECT k, min(i) FILTER (NOT ok) AS bad FROM judged GROUP BY k)
      SELECT j.k AS doc, i - 1 AS pos, coalesce(code, '000000') AS defaulted,
        CASE WHEN i = bad THEN '123456' ELSE code END AS corrected FROM judged j JOIN firsts f ON f.k = j.k""",
)
def tariff_nested_fix(spark, sf_dir):
    goods = F.col("EntrySummaryDeclaration.GoodsItem")
    both = F.arrays_zip(
        tariff.default_missing_items(goods).alias("a"), tariff.correct_first_item(goods, F.lit("123456")).alias("b")
    )
    rows = decl.documents(spark, sf_dir).select("doc", F.posexplode(both).alias("pos", "item"))
    return rows.select(
        "doc",
        F.col("pos").cast("long").alias("pos"),
        tariff.item_code(F.col("item.a")).alias("defaulted"),
        tariff.item_code(F.col("item.b")).alias("corrected"),
    )
