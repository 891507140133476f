"""Lexicon filter and topic tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.functions.binding import computed_once
from lawtide.functions.lexicon import (
    HR_SCOPE, Scope, found_stems, keyword_hit, searched_text, tags_by_pattern, tags_of,
)


def keyword_filter(
    df: DataFrame, scope: Scope = HR_SCOPE, enabled: bool = True,
    text: str = "text", context: str | None = None,
) -> DataFrame:
    if not enabled:
        return df
    return df.where(keyword_hit(_searched(text, context), scope))


def keyword_filter_with_notes(
    df: DataFrame, notes: DataFrame, tags: Column, enabled: bool = True, key: str = "issue_id",
) -> DataFrame:
    """Rows hit in their text or in the note of their issue, both with what `with_tags` found in them.

    `tags` are the topics of a scope; `own_topics` those of the text, `note_topics` of the note (NULL: no
    hit). A note is searched once, apart from the paragraphs, and its topics alone join them. No stem
    spans the line break that would stand between the two.
    """
    rows = df.withColumn("own_topics", tags).drop("_found").join(
        notes.select(key, tags.alias("note_topics")), key, "left")
    if not enabled:
        return rows
    return rows.where(F.col("note_topics").isNotNull() | F.col("own_topics").isNotNull())


def _searched(text: str, context: str | None) -> Column:
    return searched_text(F.col(text), None if context is None else F.col(context))


def with_tags(
    df: DataFrame, scopes: Sequence[Scope], text: str = "text", context: str | None = None,
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with what the lexicons found, and per scope its topics (NULL = no hit).

    One pass over a text finds the stems of all scopes; topics are looked up from
    the few stems found. The helper column is `_found`.
    """
    found = found_stems(_searched(text, context), scopes)
    if found is None:
        rows = computed_once(df, _found=_searched(text, context))
        return rows, {s.name: tags_by_pattern(F.col("_found"), s) for s in scopes}
    rows = computed_once(df, _found=found)
    return rows, {s.name: tags_of(F.col("_found"), s, scopes) for s in scopes}


def tag_topics(
    df: DataFrame, scope: Scope = HR_SCOPE, text: str = "text", context: str | None = None,
    out: str = "topics",
) -> DataFrame:
    """Sorted topics of every row; empty when nothing is hit."""
    rows, tags = with_tags(df, [scope], text, context)
    none = F.array().cast("array<string>")
    return rows.withColumn(out, F.coalesce(tags[scope.name], none)).drop("_found")


def match_scopes(
    df: DataFrame, scopes: Sequence[Scope], text: str = "text", context: str | None = None,
) -> DataFrame:
    """One row per paragraph and scope whose lexicon it hits, with threshold and topics.

    Scopes are literals of the plan, not a joined table, so nothing is multiplied
    before it has matched.
    """
    rows, tags = with_tags(df, scopes, text, context)
    matches = F.array(*[
        F.struct(
            F.lit(s.name).alias("scope"), F.lit(float(s.threshold)).alias("threshold"),
            tags[s.name].alias("topics"))
        for s in scopes
    ])
    hits = F.filter(matches, lambda m: m["topics"].isNotNull())
    return rows.withColumn("_match", F.explode(hits)).select(
        *df.columns, "_match.scope", "_match.threshold", "_match.topics")
