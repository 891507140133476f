"""Paragraphs of an issue, from its HTML body or from the texts of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.functions.anchors import inferred_anchor, paragraph_anchor
from lawtide.functions.binding import computed_once, let
from lawtide.functions.text import INVISIBLE, node_text, strip
from lawtide.operators.ordered import running_sum
from lawtide.sources.landed import latest_landing

MARK = "\x01"
# Block elements end the text before them. Inline tags do not.
BLOCK = (
    r"(?i)</?(?:h[1-6]|p|div|li|ul|ol|dl|dt|dd|nav|article|section|header|footer|main|aside|"
    r"form|table|thead|tbody|tr|td|th|blockquote|pre|hr|figure|body|html)\b[^>]*>"
)
HEADING_START = rf"(?i){MARK}(?=<h[1-4]\b)"
PARAGRAPH = r"(?i)^<p\b"
BOX = r"""(?i)^<div\b[^>]*\bclass\s*=\s*(?:"[^"]*bekezdes|'[^']*bekezdes)"""
DIV, DIV_END = r"(?i)^<div\b", r"(?i)^</div\b"

PAGE_BREAK = "\n\n"
PAGES_PER_BLOCK = 1_000


def sections(html: Column) -> Column:
    """Sections of a body: array of (section, heading, text), empty ones left out.

    Cut at headings, then at block tags inside each section; the texts of its
    paragraphs are joined without a separator. All within the row: no shuffle,
    and the section number needs no window.
    """
    visible = F.regexp_replace(html, INVISIBLE, "")
    marked = F.regexp_replace(visible, BLOCK, MARK + "$0")

    def section(blocks: Column, number: Column) -> Column:
        # Text before the first heading belongs to a section without one.
        heading = F.when(number == 0, F.lit("")).otherwise(node_text(F.element_at(blocks, 1)))
        plain = F.transform(F.filter(blocks, lambda b: b.rlike(PARAGRAPH)), node_text)
        text = F.array_join(
            F.when(F.exists(blocks, lambda b: b.rlike(BOX)), boxed_texts(blocks)).otherwise(plain), "")
        return F.struct(
            number.cast("long").alias("section"), heading.alias("heading"), text.alias("text"))

    blocks = F.transform(F.split(marked, HEADING_START), lambda markup: F.split(markup, MARK))
    cut = F.transform(blocks, section)
    return F.filter(cut, lambda s: strip(s["text"]) != "")


def boxed_texts(blocks: Column) -> Column:
    """Paragraph texts of a section that has paragraph boxes (a div of their class).

    All text of a box is its paragraph, that of blocks nested in it included, once.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("box"), F.array().cast("array<string>").alias("texts"))

    def step(state: Column, block: Column) -> Column:
        inside = state["depth"] > 0
        change = F.when(block.rlike(DIV), 1).when(block.rlike(DIV_END), -1).otherwise(0)
        depth = F.when(inside, state["depth"] + change).otherwise(F.when(block.rlike(BOX), 1).otherwise(0))

        def advance(now: Column) -> Column:
            still, text = now["depth"] > 0, now["text"]
            joined = F.when((state["box"] == "") | (text == ""), F.concat(state["box"], text)).otherwise(
                F.concat(state["box"], F.lit(" "), text))
            texts = F.when(inside & ~still, F.concat(state["texts"], F.array(state["box"]))).when(
                ~inside & ~still & block.rlike(PARAGRAPH), F.concat(state["texts"], F.array(text))
            ).otherwise(state["texts"])
            return F.struct(
                now["depth"].alias("depth"), F.when(still, joined).otherwise(F.lit("")).alias("box"),
                texts.alias("texts"))
        return let(F.struct(depth.alias("depth"), node_text(block).alias("text")), advance)

    return F.aggregate(
        blocks, start, step, lambda end: F.concat(end["texts"], F.array(end["box"])))


def html_paragraphs(bodies: DataFrame, key: str = "issue_id") -> DataFrame:
    """(key, pos, anchor, heading, text) of every section of every body; pos counts from 0."""
    found = bodies.select(key, F.posexplode(sections(F.col("html"))).alias("pos", "s"))
    return found.select(
        key, F.col("pos").cast("long").alias("pos"), paragraph_anchor(F.col("s.heading")).alias("anchor"),
        F.col("s.heading").alias("heading"), F.col("s.text").alias("text"))


def first_section_text(html: Column) -> Column:
    return F.try_element_at(sections(html), F.lit(1))["text"]


def split_chunks(text: Column, separator: str = PAGE_BREAK) -> Column:
    return F.split(text, separator)


def _bare(page_text: Column) -> Column:
    """Page text without outer line breaks; a page without text is empty."""
    return F.trim(F.coalesce(page_text, F.lit("")), F.lit("\n"))


def page_offsets(pages: DataFrame, key: str = "issue_id") -> DataFrame:
    """Where each page starts in the text of its issue (pages joined by a blank line).

    (key, page_no, start, page_text): the whole text, without building it in one cell.
    """
    bare = pages.withColumn("page_text", _bare(F.col("page_text")))
    return running_sum(
        bare, [key], ["page_no"], F.length("page_text") + F.lit(len(PAGE_BREAK)),
        F.floor(F.col("page_no") / PAGES_PER_BLOCK), "start",
    ).select(key, "page_no", "start", "page_text")


def page_chunks(
    pages: DataFrame, key: str = "issue_id", min_chars: int = 30, separator: str = PAGE_BREAK,
) -> DataFrame:
    """Chunks of an issue's joined page texts, cut at `separator`.

    Chunks are numbered through the whole issue before short ones are dropped. A
    page's chunks are cut in its own row; only chunk counts cross pages, so no text
    is gathered per issue.
    """
    cut = pages.withColumn("_chunks", split_chunks(_bare(F.col("page_text")), separator))
    # A page break that is no chunk separator of its own adds the empty chunks it is cut into.
    gap = PAGE_BREAK.count(separator) - 1
    numbered = running_sum(
        cut, [key], ["page_no"], F.size("_chunks") + F.lit(gap),
        F.floor(F.col("page_no") / PAGES_PER_BLOCK), "_before")
    return _chunk_rows(numbered, key, F.col("_before"), min_chars)


def text_chunks(
    texts: DataFrame, key: str = "issue_id", min_chars: int = 30, separator: str = PAGE_BREAK,
) -> DataFrame:
    """`page_chunks` for issues landed as one text each: no shuffle at all."""
    cut = texts.withColumn("_chunks", split_chunks(F.coalesce("page_text", F.lit("")), separator))
    return _chunk_rows(cut, key, F.lit(0), min_chars)


def _chunk_rows(cut: DataFrame, key: str, before: Column, min_chars: int) -> DataFrame:
    rows = cut.select(key, before.alias("_before"), F.posexplode("_chunks").alias("_i", "_chunk"))
    stripped = rows.select(
        key, (F.col("_before") + F.col("_i") + 1).cast("long").alias("pos"),
        strip(F.col("_chunk")).alias("text")).where(F.length("text") >= min_chars)
    return stripped.select(
        key, "pos",
        F.coalesce(inferred_anchor(F.col("text")), F.concat(F.lit("p"), F.col("pos"))).alias("anchor"),
        F.lit("").alias("heading"), "text")


def with_fallback(html: DataFrame, chunks: DataFrame, key: str = "issue_id") -> DataFrame:
    """HTML paragraphs; chunks stand in for every issue whose HTML gave none.

    First paragraphs are one row per issue without an aggregate, so that Spark can
    split an issue that holds most of the chunks.
    """
    given = html.where("pos = 0").select(key)
    return html.unionByName(chunks.join(given, key, "left_anti"))


def justification_notes(
    issues: DataFrame, justifications: DataFrame, key: str = "issue_id",
) -> DataFrame:
    """(issue, justification_url, justification_text): the first justification paragraph of each issue, of
    its latest landing."""
    wanted = issues.where("has_justification").select(key, "justification_url")
    latest = latest_landing(justifications.join(wanted, key, "left_semi"), key=key)
    return computed_once(
        latest.join(wanted, key), justification_text=first_section_text(F.col("html")),
    ).drop("html").where(F.col("justification_text").isNotNull())


def with_note(rows: DataFrame, notes: DataFrame, key: str = "issue_id") -> DataFrame:
    """Rows with the note of their issue."""
    return rows.join(notes, key, "left").withColumn(
        "has_justification", F.col("justification_text").isNotNull(),
    ).withColumn("justification_text", F.coalesce("justification_text", F.lit("")))


def with_justification(
    paragraphs: DataFrame, issues: DataFrame, justifications: DataFrame, key: str = "issue_id",
) -> DataFrame:
    """Put the first justification paragraph of an issue on all its paragraphs."""
    return with_note(paragraphs, justification_notes(issues, justifications, key), key)


def long_enough(paragraphs: DataFrame, min_chars: int = 30) -> DataFrame:
    return paragraphs.where(F.length("text") >= min_chars)
