"""Text repair: garbled encodings, accents, character whitelists, raw document text."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# UTF-8 text that was once decoded as Windows-1252.
ENCODING_REPAIRS = {
    "Ãœ": "U",
    "Ã¼": "u",
    "Ä°": "I",
    "Ä±": "i",
    "Åž": "S",
    "ÅŸ": "s",
    "Ã‡": "C",
    "Ã§": "c",
    "Ã–": "O",
    "Ã¶": "o",
    "Äž": "G",
    "ÄŸ": "g",
}

# Characters that survive cleaning, and the ones a GB filing must not hold.
ALLOWED = "[a-zA-Z0-9 /.,'&()-]"
NOT_ALLOWED = "[^a-zA-Z0-9 /.,'&()-]"
SPECIALS = "&#$%*"

# White space as the Unicode-aware regex engines see it; valid in Java and RE2.
WHITESPACE_RUN = r"[\t\n\x0B\f\r\x{85}\p{Z}]{2,}"

# Stand in for escaped angle brackets while ampersands are rewritten (private use characters).
_LT, _GT = "\ue000", "\ue001"


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks, and that base.

    Hangul syllables decompose into several letters and stay as they are; the whitelist drops them
    either way.
    """
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        base = [p for p in parts if not unicodedata.category(p).startswith("M")]
        if len(base) == 1:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def repair_encoding(text: Column) -> Column:
    for garbled, letter in ENCODING_REPAIRS.items():
        text = F.replace(text, F.lit(garbled), F.lit(letter))
    return text


def strip_accents(text: Column) -> Column:
    source, target = accent_map()
    return F.regexp_replace(F.translate(text, source, target), r"\p{M}", "")


def _plain(text: Column) -> Column:
    """Repaired text without accents; ASCII text has neither to repair and takes the short way."""
    return F.when(is_ascii(text), text).otherwise(strip_accents(repair_encoding(text)))


def clean(text: Column) -> Column:
    """Repair, drop accents, keep only allowed characters. Null and empty pass through."""
    return F.regexp_replace(_plain(text), NOT_ALLOWED, "")


def removed_characters(text: Column) -> Column:
    """What ``clean`` takes out, in order, with neighbouring repeats reported once."""
    removed = F.regexp_replace(_plain(text), ALLOWED, "")
    return F.regexp_replace(removed, r"(?s)(.)\1+", "$1")


def clean_if_dirty(text: Column) -> Column:
    """``clean`` only where a character has to go: an accent alone is no reason to rewrite."""
    return F.when(_plain(text).rlike(NOT_ALLOWED), clean(text)).otherwise(text)


def strip_specials(text: Column) -> Column:
    for char in SPECIALS:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def strip(text: Column) -> Column:
    """Trim every common kind of white space, not only blanks."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r\x85\xa0"))


def normalize_document(text: Column) -> Column:
    """Prepare raw document text for parsing.

    Apostrophes go, ampersands become words (escaped ones are decoded first; escaped angle brackets
    stay escaped), white space runs collapse, house number ``00`` becomes N/A and notify parties
    become consignees.
    """
    lit = F.lit
    for old, new in (
        ("&lt;", _LT),
        ("&gt;", _GT),
        ("&apos;", "'"),
        ("&quot;", '"'),
        ("&amp;", "&"),
        ("&;", " and "),
        ("'", ""),
        ("&", " and "),
        (_LT, "&lt;"),
        (_GT, "&gt;"),
    ):
        text = F.replace(text, lit(old), lit(new))
    text = F.regexp_replace(text, WHITESPACE_RUN, " ")
    for old, new in (
        ("<number>00</number>", "<number>N/A</number>"),
        ("<NotifyParty>", "<Consignee>"),
        ("</NotifyParty>", "</Consignee>"),
    ):
        text = F.replace(text, lit(old), lit(new))
    return text


def redact_password(xml: Column) -> Column:
    """Take the sender's password element out of raw document text, up to the end of a text cut inside it."""
    whole = r"(?is)<((?:[\w.-]+:)?RecipientPwd)\b(?:[^<>]*/>|[^<>]*(?:>.*?(?:</\1\s*>|\z)|\z))"
    return F.regexp_replace(xml, whole, "")
