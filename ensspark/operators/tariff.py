"""Tariff checks over flat goods items and over nested documents.

Flat items are rows ``(doc, pos, item_number, description, tariff, harmonized)``, so a document of
any size is checked with partial aggregates. Nested documents are checked in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensspark.functions.tariff import correction_ok, current_code, scan_ok, six_digits
from ensspark.functions.values import blank
from ensspark.schemas import MISSING_TARIFF


def code() -> Column:
    return current_code(F.col("tariff"), F.col("harmonized"))


def check_documents(documents: DataFrame, items: DataFrame, scan: bool = False) -> DataFrame:
    """One row per document: ``items``, ``failed_items`` and ``valid``.

    Batch rule: a missing code fails and so does a document without items. Scan rule: blank text
    fails too, and a document without items is fine.
    """
    ok = scan_ok(code()) if scan else six_digits(code())
    tally = items.groupBy("doc").agg(F.count(F.lit(1)).alias("items"), F.count_if(~ok).alias("failed_items"))
    checked = documents.join(tally, "doc", "left").fillna(0, ["items", "failed_items"])
    valid = F.col("failed_items") == 0
    return checked.withColumn("valid", valid if scan else valid & (F.col("items") > 0))


def first_issues(items: DataFrame) -> DataFrame:
    """First failing item of each document by the scan rule; a partial aggregate, no sort."""
    found = F.struct(
        "pos",
        F.coalesce("item_number", F.col("pos").cast("string")).alias("item_number"),
        F.when(blank(F.col("description")), "(Not Found)").otherwise(F.col("description")).alias("description"),
        F.coalesce(code(), F.lit("(Missing)")).alias("current_value"),
    )
    failing = items.filter(~scan_ok(code()))
    return failing.groupBy("doc").agg(F.min_by(found, "pos").alias("issue")).select("doc", "issue.*")


def default_missing(items: DataFrame) -> DataFrame:
    """Give items without any code the placeholder, and flag them."""
    missing = code().isNull()
    return items.withColumn("tariff_defaulted", missing).withColumn(
        "tariff", F.when(missing, MISSING_TARIFF).otherwise(F.col("tariff"))
    )


def correct_first_issue(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """Write a typed-in code ``(doc, code)`` to the first failing item of the document.

    Other spellings of the code go. Codes that are not six digits are ignored.
    """
    good = corrections.filter(correction_ok(F.col("code"))).select("doc", F.trim("code").alias("_code"))
    target = first_issues(items).select("doc", "pos").join(good, "doc")
    hit = F.col("_code").isNotNull()
    return (
        items.join(target, ["doc", "pos"], "left")
        .withColumn("tariff", F.when(hit, F.col("_code")).otherwise(F.col("tariff")))
        .withColumn("harmonized", F.when(~hit, F.col("harmonized")))
        .drop("_code")
    )


def summary(checked: DataFrame) -> DataFrame:
    """Valid documents of all, and distinct failed references, case aside."""
    failed = F.when(~F.col("valid"), F.lower("reference"))
    return checked.agg(
        F.count_if("valid").alias("valid_documents"),
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct(failed).alias("failed_references"),
    )


def failed_references(checked: DataFrame) -> DataFrame:
    """References of failed documents, each once (case aside, smallest spelling)."""
    failed = checked.filter(~F.col("valid"))
    return failed.groupBy(F.lower("reference").alias("_key")).agg(F.min("reference").alias("reference")).drop("_key")


# --- nested documents ---------------------------------------------------------------------------


def item_code(item: Column) -> Column:
    return current_code(item["TariffNumber"], item["harmonizedSystemSubHeadingCode"])


def document_valid(goods: Column, scan: bool = False) -> Column:
    """Tariff verdict of a document with its goods items in the row."""
    failing = F.exists(goods, lambda item: ~(scan_ok(item_code(item)) if scan else six_digits(item_code(item))))
    empty = F.coalesce(F.size(goods), F.lit(0)) <= 0
    return F.when(empty, F.lit(scan)).otherwise(~failing)


def default_missing_items(goods: Column) -> Column:
    """Placeholder code in items that have none."""
    return F.transform(
        goods,
        lambda item: F.when(
            item_code(item).isNull(), item.withField("TariffNumber", F.lit(MISSING_TARIFF))
        ).otherwise(item),
    )


def correct_first_item(goods: Column, new_code: Column) -> Column:
    """Write a correct code to the first failing item; anything else stays."""
    failing = F.transform(goods, lambda item: ~scan_ok(item_code(item)))
    at = F.coalesce(F.array_position(failing, F.lit(True)), F.lit(0)).cast("int")
    # Pieces around the item instead of a lambda over all: the position is computed once per row.
    fixed = (
        F.get(goods, at - 1)
        .withField("TariffNumber", F.trim(new_code))
        .withField("harmonizedSystemSubHeadingCode", F.lit(None).cast("string"))
    )
    before = F.slice(goods, F.lit(1), F.greatest(at - 1, F.lit(0)))
    after = F.slice(goods, at + 1, F.size(goods))
    return F.when(correction_ok(new_code) & (at > 0), F.concat(before, F.array(fixed), after)).otherwise(goods)
