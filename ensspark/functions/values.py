"""Small column helpers: blanks, lists, ports, dates, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ensspark.functions.text import strip


def blank(value: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(value) == "", F.lit(True))


def blank_to_null(value: Column) -> Column:
    return F.when(~blank(value), value)


def or_default(value: Column, default: str) -> Column:
    """The value, or a default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def csv_to_list(csv: Column) -> Column:
    """Codes of a comma-joined list, trimmed, without empties; null gives an empty list."""
    codes = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), strip)
    return F.filter(codes, lambda code: code != "")


def list_to_csv(codes: Column) -> Column:
    return F.array_join(codes, ",")


def country(port: Column) -> Column:
    return F.substring(port, 1, 2)


def position(items: Column, value: Column) -> Column:
    """1-based position; 0 for a miss, null list or null value."""
    return F.coalesce(F.array_position(items, value), F.lit(0)).cast("int")


def slice_between(items: Column, first: Column, last: Column) -> Column:
    """Items at positions first..last (1-based); null where that is no valid range."""
    valid = (first >= 1) & (last >= first)
    # Clamp before slicing: both branches of a conditional may be evaluated.
    start = F.greatest(first, F.lit(1))
    length = F.greatest(last - first + 1, F.lit(0))
    return F.when(valid, F.slice(items, start, length))


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd text to a date; null where it is not one."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def compact_date(text: Column) -> Column:
    """True where the text is eight digits."""
    return F.coalesce(text.rlike("^[0-9]{8}$"), F.lit(False))


def document_time(text: Column) -> Column:
    """yyyyMMddHHmm text (blanks allowed anywhere) to a timestamp; null where it is not one."""
    digits = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(digits.rlike("^[0-9]{12}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm")))


def zulu(ts: Column) -> Column:
    """ISO text with a literal Z; no zone conversion takes place."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def midnight_stamp(day: Column) -> Column:
    """A date as yyyyMMdd0000."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("0000"))


def vessel_code(path: Column) -> Column:
    """First four characters of the last path part, upper case."""
    leaf = F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)
    return F.upper(F.substring(leaf, 1, 4))


def relative_path(path: Column, root: str) -> Column:
    """The part of the path below ``root``, without a leading separator."""
    prefix = root.rstrip("/\\")
    inside = F.startswith(path, F.lit(prefix))
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    return F.when(inside, F.regexp_replace(rest, r"^[/\\]+", "")).otherwise(path)


def reference_or_fallback(reference: Column, file_name: Column) -> Column:
    """Commercial reference; a text naming the file where it is missing or blank."""
    missing = F.concat(F.lit("CommercialRefNum-NotFound-in-File-"), file_name)
    return F.coalesce(blank_to_null(reference), missing)


def same_text(left: Column, right: Column) -> Column:
    """Equality that ignores case and treats two nulls as equal."""
    return F.lower(left).eqNullSafe(F.lower(right))


def existing(old: Column, new: Column) -> Column:
    """Replace the text of an element that exists; an absent element stays absent."""
    return F.when(old.isNotNull(), F.coalesce(new, old))


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
