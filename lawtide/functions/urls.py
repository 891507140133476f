"""Document addresses."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawtide.functions.text import TAG, decode_entities

# Path pieces of the publication site.
DOCUMENTS = "/dokumentumok/"
VIEW, DOWNLOAD, JUSTIFICATION = "/megtekintes", "/letoltes", "/indokolas"
VIEW_HREF = rf"[^\"']*{DOCUMENTS}[^/\"']+{VIEW}[^\"']*"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
JUSTIFICATION_HINT = "indokl"


def link_pattern(href: str = VIEW_HREF) -> str:
    """Pattern of a whole anchor element whose address matches `href`."""
    return rf"""(?is)<a\b[^>]*?\bhref\s*=\s*["']{href}["'][^>]*>.*?</a>"""


def links(markup: Column, href: str = VIEW_HREF) -> Column:
    """All anchor elements with a matching address, as an array."""
    return F.regexp_extract_all(markup, F.lit(link_pattern(href)), F.lit(0))


def link_href(link: Column) -> Column:
    return decode_entities(F.regexp_extract(link, HREF, 1))


def absolute_url(href: Column, base_url: str) -> Column:
    """Drop a section prefix, then resolve against the site's address."""
    site = urlsplit(base_url)
    short = F.regexp_replace(href, r"^/hivatalos-lapok/[^/]+/", "/")
    rooted = F.when(F.startswith(short, F.lit("/")), short).otherwise(F.concat(F.lit("/"), short))
    plain = F.regexp_replace(rooted, r"^(?:/\.{1,2})+/", "/")
    return (
        F.when(short.rlike("^https?://"), short)
        .when(F.startswith(short, F.lit("//")), F.concat(F.lit(site.scheme + ":"), short))
        .otherwise(F.concat(F.lit(f"{site.scheme}://{site.netloc}"), plain))
    )


def download_url(view_url: Column) -> Column:
    return F.replace(view_url, F.lit(VIEW), F.lit(DOWNLOAD))


def justification_url(view_url: Column, has_justification: Column) -> Column:
    return F.when(has_justification, F.replace(view_url, F.lit(VIEW), F.lit(JUSTIFICATION)))


def has_justification_link(markup: Column) -> Column:
    """Any link whose address, or whose own text, holds the hint."""
    hrefs = F.regexp_extract_all(markup, F.lit(HREF), F.lit(1))
    labels = F.regexp_extract_all(markup, F.lit(r"(?is)<a\b[^>]*\bhref[^>]*>(.*?)</a>"), F.lit(1))
    shown = F.transform(labels, lambda x: F.regexp_replace(x, TAG, ""))
    return F.exists(
        F.concat(hrefs, shown), lambda x: F.contains(F.lower(x), F.lit(JUSTIFICATION_HINT)))
