"""Publication dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawtide.functions.text import WS

# Hungarian month names, with one misspelling seen in the source.
MONTHS = {
    "január": 1, "február": 2, "március": 3, "április": 4, "május": 5, "június": 6,
    "július": 7, "augusztus": 8, "szeptember": 9, "október": 10, "november": 11,
    "december": 12, "decemebr": 12,
}

DATE_TEXT = rf"(?iu)([0-9]{{4}})\.{WS}*({'|'.join(MONTHS)}){WS}*([0-9]{{1,2}})"


def local_date(text: Column) -> Column:
    """First "yyyy. month d." of a text as a date; a day that does not exist gives NULL."""
    # One chain, so that the text is searched once.
    parts = F.lower(F.regexp_replace(F.regexp_extract(text, DATE_TEXT, 0), DATE_TEXT, "$1-$2-$3"))
    for name, number in MONTHS.items():
        parts = F.replace(parts, F.lit(name), F.lit(str(number)))
    return F.try_to_date(parts, "yyyy-M-d")


def published_date(markup: Column, text: Column) -> Column:
    """Machine-readable date of an entry, else the first date in its text."""
    meta = F.regexp_extract(
        markup, r"""(?is)<meta\b[^>]*itemprop\s*=\s*["']datePublished["'][^>]*>""", 0)
    iso = F.regexp_extract(meta, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), local_date(text))
