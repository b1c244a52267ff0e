"""Parsing of counters, ids, dates and page texts as columns."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from upwell.config import SITE, SNIPPET_CHARS

#: Fixed patterns of the raw texts. Blanks are those of Unicode, which Java's ``\\s`` lacks.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ \t]*([万億KkMm]?)$"
COUNT = r"[\p{Nd},.]+[万億KkMm]?"
VIEWS = rf"(?i)([\p{{Nd}},.]+[万億KkMm]?)[{BLANK}]*Views?"
AFTER_VIEWS = rf"(?is)[\p{{Nd}},.]+[万億KkMm]?[{BLANK}]*Views?(.*)"
END_OF_STATS = "Relevant"
LEGACY_DATE = "MMM dd HH:mm:ss Z yyyy"
#: Multipliers of the units; a number without one counts as it is.
UNITS = {"": 1.0, "万": 1e4, "億": 1e8, "K": 1e3, "k": 1e3, "M": 1e6, "m": 1e6}

#: Decimal digits of other scripts, and the ASCII digit that each stands for.
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_FOREIGN, _ASCII = "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def trimmed(s: Column) -> Column:
    """Without white space at both ends, that of Unicode included."""
    return F.regexp_replace(s, f"^[{BLANK}]+|[{BLANK}]+$", "")


def parse_count(raw: Column) -> Column:
    """A localized counter as a number, truncated; 0 for anything else.

    Digits of any script count. Unlike in some parsers, digits may not be grouped by "_".
    """
    s = F.replace(trimmed(F.coalesce(raw, F.lit(""))), F.lit(","), F.lit(""))
    s = F.when(F.octet_length(s) != F.length(s), F.regexp_replace(F.translate(s, _FOREIGN, _ASCII), f"[{BLANK}]", " ")).otherwise(s)
    unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.regexp_extract(s, NUMBER, 2))
    # a counter beyond the range of long is no counter
    return F.coalesce((F.regexp_extract(s, NUMBER, 1).try_cast("double") * unit).try_cast("bigint"), F.lit(0).cast("long"))


def label_count(label: Column) -> Column:
    """The first counter in a label, else 0."""
    return parse_count(F.regexp_extract(F.coalesce(label, F.lit("")), COUNT, 0))


def post_id(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/status/(\p{Nd}+)", 1)


def handle(href: Column) -> Column:
    """First segment of a profile path."""
    return F.split_part(F.trim(F.coalesce(href, F.lit("")), F.lit("/")), F.lit("/"), F.lit(1))


def absolute_url(href: Column) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(SITE), href)).otherwise(href)


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def iso_time(s: Column) -> Column:
    """ISO 8601 with or without zone (UTC then); null if it is no such time."""
    return F.try_to_timestamp(s)


def legacy_time(s: Column) -> Column:
    """A date like ``Tue Jan 16 00:00:00 +0000 2024``; null if it is no such date."""
    return F.try_to_timestamp(F.substring(s, F.lit(5), F.length(s)), F.lit(LEGACY_DATE))


def impressions(detail: Column) -> Column:
    return parse_count(F.regexp_extract(F.coalesce(detail, F.lit("")), VIEWS, 1))


def bookmarks(detail: Column) -> Column:
    """The fourth number after the first views counter and before the end of the statistics."""
    after = F.regexp_extract(F.coalesce(detail, F.lit("")), AFTER_VIEWS, 1)
    stats = F.substring_index(after, END_OF_STATS, 1)
    return parse_count(F.try_element_at(F.regexp_extract_all(stats, F.lit(COUNT), F.lit(0)), F.lit(4)))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def percent(x: Column) -> Column:
    """A share in whole percent, halves to even."""
    return F.rint(x * F.lit(100.0)).cast("bigint")


def quote_query(s: Column) -> Column:
    """A search query percent-encoded for a URL, blanks as %20 and slashes as they are."""
    coded = F.url_encode(s)
    for coded_as, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(coded_as), F.lit(wanted))
    return coded
