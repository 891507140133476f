"""Issues of a publication, read from its landed listing pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawtide.functions import urls
from lawtide.functions.dates import published_date
from lawtide.functions.text import INVISIBLE, WS, node_text
from lawtide.operators.ordered import first_per

# Fixed values of the publication.
SISTER_BULLETIN = "Hivatalos Értesítő"
ISSUE_NUMBER = rf"([0-9]{{4}})\.{WS}*évi{WS}+([0-9]+)\.{WS}*szám"
ENTRY = r"""(?is)(<div\b[^>]*\bclass\s*=\s*["'][^"']*fresh-row)"""

MARK = "\x01"


def reachable_pages(
    pages: DataFrame, max_pages: int | None = None, document_link: str = urls.DOCUMENTS,
) -> DataFrame:
    """Pages a reader sees who walks from page 1: up to the first failed page
    (NULL html, left out) or the first page without document links (kept)."""
    if max_pages is not None:
        pages = pages.where(F.col("page_no") <= max_pages)
    failed = F.when(F.col("html").isNull(), F.col("page_no"))
    linkless = F.when(~F.contains("html", F.lit(document_link)), F.col("page_no"))
    # One row; a scalar subquery keeps the filter in the same job.
    ends = pages.agg(F.min(failed).alias("failed"), F.min(linkless).alias("linkless"))
    first_failed, first_linkless = ends.select("failed").scalar(), ends.select("linkless").scalar()
    page_no = F.col("page_no")
    return pages.where(
        (first_failed.isNull() | (page_no < first_failed))
        & (first_linkless.isNull() | (page_no <= first_linkless)))


def entry_markup(html: Column) -> Column:
    """Markup of each listing entry. Pages without entry boxes are cut at their links."""
    visible = F.regexp_replace(html, INVISIBLE, "")
    boxed = F.regexp_replace(visible, ENTRY, MARK + "$1")
    linked = F.regexp_replace(visible, rf"({urls.link_pattern()})", MARK + "$1")
    return F.split(F.when(F.contains(boxed, F.lit(MARK)), boxed).otherwise(linked), MARK)


def page_links(pages: DataFrame) -> DataFrame:
    """One row per document link: (page_no, pos, entry, entry_text, href, label), in page order."""
    # Texts are made inside the arrays that are exploded: once per entry, once per link.
    entries = F.transform(entry_markup(F.col("html")), lambda e: F.struct(
        e.alias("entry"), node_text(e).alias("entry_text")))
    boxes = pages.where("html IS NOT NULL").select(
        "page_no", F.posexplode(entries).alias("entry_no", "e"))
    found = F.transform(urls.links(F.col("e.entry")), lambda link: F.struct(
        urls.link_href(link).alias("href"), link_label(link).alias("label")))
    rows = boxes.select("page_no", "entry_no", "e", F.posexplode(found).alias("link_no", "l"))
    return rows.select(
        "page_no", F.struct("entry_no", "link_no").alias("pos"), "e.entry", "e.entry_text",
        "l.href", "l.label")


def link_label(link: Column) -> Column:
    """Text of a link with the texts of its children, such as a bold one; empty if it has none."""
    return node_text(link)


def issue_id(label: Column) -> Column:
    """"year/number" of an issue label, NULL when it holds none."""
    found = F.regexp_extract(label, ISSUE_NUMBER, 0)
    return F.nullif(F.regexp_replace(found, ISSUE_NUMBER, "$1/$2"), F.lit(""))


def link_issues(links: DataFrame, base_url: str) -> DataFrame:
    """Parse links to issue rows; drops the sister bulletin, unnumbered and undated rows."""
    labelled = links.withColumnRenamed("label", "issue_number").where(
        ~F.contains("issue_number", F.lit(SISTER_BULLETIN)))
    numbered = labelled.withColumn("issue_id", issue_id(F.col("issue_number"))).where(
        F.col("issue_id").isNotNull())
    dated = numbered.withColumn(
        "issue_date", published_date(F.col("entry"), F.col("entry_text")),
    ).withColumn("has_justification", urls.has_justification_link(F.col("entry")))
    view = urls.absolute_url(F.col("href"), base_url)
    placed = dated.withColumn("view_url", view)
    return placed.select(
        "page_no", "pos", "issue_id", "issue_number", "issue_date", "has_justification", "view_url",
        urls.download_url(F.col("view_url")).alias("pdf_url"),
        urls.justification_url(F.col("view_url"), F.col("has_justification")).alias("justification_url"),
    )


def page_issues(pages: DataFrame, base_url: str) -> DataFrame:
    """The first entry of each issue on each page, if it is dated. An undated one still hides later
    entries of the issue on its page."""
    per_page = first_per(link_issues(page_links(pages), base_url), ["page_no", "issue_id"], ["pos"])
    return per_page.where(F.col("issue_date").isNotNull()).drop("pos")


def listed_issues(pages: DataFrame, base_url: str, window: tuple | None = None) -> DataFrame:
    """One row per issue: first entry within a page, last page wins.

    With a window (both ends inclusive), entries outside it are left out before pages are compared: an
    issue that a later page lists under a date outside the window stays as the earlier page lists it.
    """
    dated = page_issues(pages, base_url)
    if window is not None:
        dated = in_window(dated, *window)
    return first_per(dated, ["issue_id"], [F.desc("page_no")])


def issues_by_scope(entries: DataFrame, windows: Mapping[str, tuple]) -> DataFrame:
    """`listed_issues` for the window of every scope, from entries of pages that are parsed once: a row
    per scope and issue. Entries outside all windows go first."""
    if not windows:
        raise ValueError("no scope")
    inside = in_window(entries, min(a for a, _ in windows.values()), max(b for _, b in windows.values()))
    every = F.array(*[
        F.struct(F.lit(s).alias("scope"), F.lit(a).alias("first"), F.lit(b).alias("last")) for s, (a, b) in windows.items()])
    own = F.filter(every, lambda w: F.col("issue_date").between(w["first"], w["last"]))
    rows = inside.withColumn("scope", F.explode(F.transform(own, lambda w: w["scope"])))
    return first_per(rows, ["scope", "issue_id"], [F.desc("page_no")])


def in_window(df: DataFrame, start, end, column: str = "issue_date") -> DataFrame:
    """Both ends inclusive; literal bounds, so partition and file pruning apply."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def newest_per(issues: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The first `limit` of `newest` for each key; every task sends at most so many a key."""
    own = Window.partitionBy(*keys).orderBy(F.desc("issue_date"), F.desc("issue_id"))
    ranked = issues.withColumn("_rank", F.row_number().over(own))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def newest(issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; equal dates by issue id as text. `limit` plans as a top-k."""
    ordered = issues.orderBy(F.desc("issue_date"), F.desc("issue_id"))
    return ordered if limit is None else ordered.limit(limit)
