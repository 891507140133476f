"""Paragraph anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawtide.functions.text import WORD_CHAR, WS

# Section mark, roman-numbered chapter, number in brackets: the leftmost wins.
ANCHOR = (
    rf"[0-9]{{1,3}}\.{WS}*§"
    rf"|(?<![{WORD_CHAR}])[IVX]{{1,5}}\.{WS}*(?:fejezet|cím|alcím|rész)(?![{WORD_CHAR}])"
    r"|\([1-9][0-9]?\)"
)
UNKNOWN_ANCHOR = "ismeretlen"


def inferred_anchor(text: Column) -> Column:
    """Anchor named in a text, NULL if there is none."""
    # One chain, so that the text is searched once.
    found = F.regexp_extract(text, ANCHOR, 0)
    section = F.regexp_replace(found, r"(?s)^([0-9]+)\..*$", "$1. §")
    chapter = F.regexp_replace(section, r"(?s)^([IVX]+)\..*$", "$1. fejezet")
    return F.nullif(chapter, F.lit(""))


def paragraph_anchor(heading: Column) -> Column:
    """Anchor of a section: inferred, else the start of its heading, else a fixed word."""
    return F.coalesce(
        inferred_anchor(heading),
        F.nullif(F.substring(heading, 1, 40), F.lit("")),
        F.lit(UNKNOWN_ANCHOR),
    )
