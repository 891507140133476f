"""Joins against issues and state: what is known, what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.functions.text import content_hash
from lawtide.operators.ordered import first_per

# No side is broadcast by hint here: tables of this module grow with the archive.
# Spark broadcasts a side whose measured size is under its threshold, and splits
# skewed partitions of the others (anti, semi and left joins split their left side).


def unprocessed(issues: DataFrame, progress: DataFrame) -> DataFrame:
    """Issues without a progress row."""
    return issues.join(progress.select("issue_id"), "issue_id", "left_anti")


def of_issues(reported: DataFrame, issues: DataFrame) -> DataFrame:
    """The part of the state that can matter to these issues.

    The archive only grows; a run looks at few issues. Cut to them, its keys are small
    enough to be broadcast or cheap to shuffle.
    """
    return reported.join(issues.select("issue_number"), "issue_number", "left_semi")


def unreported(
    rows: DataFrame, reported: DataFrame, keys: Sequence[str] = ("issue_number", "anchor"),
) -> DataFrame:
    """Rows whose key no earlier run reported. Repeats inside `rows` all stay."""
    return rows.join(reported.select(*keys), list(keys), "left_anti")


def first_writer(
    rows: DataFrame, keys: Sequence[str] = ("issue_number", "anchor"),
    order: Sequence[str | Column] = ("issue_id", "pos"),
) -> DataFrame:
    return first_per(rows, list(keys), list(order))


def with_issue(paragraphs: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue number and date on each paragraph; an unknown issue gives an empty number."""
    attributes = issues.select("issue_id", "issue_number", "issue_date")
    return paragraphs.join(attributes, "issue_id", "left").withColumn(
        "issue_number", F.coalesce("issue_number", F.lit("")))


def with_content_hash(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("content_hash", content_hash(F.col(text)))


def dedup_key(issue_number: Column, anchor: Column) -> Column:
    return F.concat(issue_number, F.lit("::"), anchor)


def link_per_label(issues: DataFrame) -> DataFrame:
    """Address of each issue label; the last of several issues with one label counts."""
    return first_per(
        issues.where(F.coalesce("issue_number", F.lit("")) != ""), ["issue_number"],
        [F.asc("issue_date"), F.asc("issue_id")],
    ).select("issue_number", F.col("view_url").alias("url"))
