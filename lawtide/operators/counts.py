"""Counts per issue and per run, progress rows, grouped items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def per_issue(rows: DataFrame, name: str, key: str = "issue_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def progress_rows(
    issues: DataFrame, classified: DataFrame, items: DataFrame, processed_at: Column,
) -> DataFrame:
    """One row per scanned issue, zero counts included.

    `classified` are the paragraphs kept by length, `items` the new ones.
    """
    counted = (
        issues.select("issue_id", "issue_date")
        .join(per_issue(classified, "items_classified"), "issue_id", "left")
        .join(per_issue(items, "items_relevant"), "issue_id", "left"))
    return counted.select(
        "issue_id", "issue_date",
        F.coalesce("items_classified", F.lit(0)).cast("long").alias("items_classified"),
        F.coalesce("items_relevant", F.lit(0)).cast("long").alias("items_relevant"),
        processed_at.alias("processed_at"))


def issues_with_items(items: DataFrame) -> DataFrame:
    return items.select("issue_id").distinct()


def funnel(flagged: DataFrame, *stages: str) -> DataFrame:
    """Rows per stage flag, one pass, one row."""
    return flagged.agg(
        F.count(F.lit(1)).alias("paragraphs"),
        *[F.count_if(F.coalesce(F.col(s), F.lit(False))).alias(s) for s in stages])


def scored_figures(threshold: float) -> dict[str, Column]:
    """Aggregates over scored rows: those that failed, and those that count as relevant."""
    return {
        "failures": F.count_if(F.coalesce("error", F.lit("")) != ""),
        "relevant": F.count_if(F.col("is_relevant") & (F.col("score") >= F.lit(float(threshold))))}


def grouped_items(items: DataFrame) -> DataFrame:
    """Items with their place within the issue, in anchor order (`item_rank` from 1).

    A row per item: an issue of any size is sorted, never gathered in a cell.
    """
    own = Window.partitionBy("issue_number", "issue_date").orderBy("anchor", "pos")
    return items.withColumn("item_rank", F.row_number().over(own))
