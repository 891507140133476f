"""Exact duplicates by progressive refinement, on DataFrame functions alone.

Rows are narrowed by the length of the normalised text, then by a hash of its beginning; only rows
alike in both are told apart by a hash of the full content. Every step counts groups with a partial
aggregation and joins the few columns of the rows with the groups that survive; no text is shuffled
unless `digest_all` is off, and then only to reach the texts of survivors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.sources.workspace import Stage

ALIKE = ["length", "beginning"]


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *,
    prefix_chars: int = 256, digest_all: bool = False,
) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are; keep_id is the smallest id among equal rows,
    kept says that it is the row's own. text_sha256 is null for a row that no other row resembles,
    as its full content is never read; with digest_all every row's digest is made in the first
    pass over the texts and the refinement runs on that pass's narrow result.

    null, empty and blank-only texts: null equals the empty text; blanks equal one space. Rows that
    repeat an id and a text count each and share `kept`. Null ids count in group_size; keep_id
    is null only if all ids of the group are. Columns beyond the two named are not read.
    """
    full = F.sha2("text", 256)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).select(
        "id", F.octet_length("text").alias("length"),
        F.xxhash64(F.substring("text", 1, prefix_chars)).alias("beginning"),
        (full if digest_all else F.col("text")).alias("content"))
    narrow = stage(rows if digest_all else rows.drop("content"), "narrow")

    lengths = stage(
        narrow.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length"), "lengths")
    alike = stage(
        narrow.join(lengths, "length").groupBy(*ALIKE).agg(F.count("*").alias("n"))
        .where("n > 1").select(*ALIKE), "alike")
    if digest_all:
        hashed = stage(narrow.join(alike, ALIKE), "hashed")
    else:
        hashed = stage(
            rows.join(alike, ALIKE)
            .select("id", *ALIKE, F.sha2("content", 256).alias("content")), "hashed")
    groups = stage(
        hashed.groupBy(*ALIKE, "content")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
        "groups")

    keys = [*ALIKE, "content"]
    if digest_all:
        told = narrow.join(groups, keys, "left")
    else:
        alone = narrow.join(alike, ALIKE, "left_anti").withColumn("content", F.lit(None).cast("string"))
        told = (
            hashed.join(groups, keys, "left")
            .unionByName(alone, allowMissingColumns=True))
    single = F.col("group_size").isNull()
    return told.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).eqNullSafe(F.col("id")).alias("kept"),
        F.col("content").alias("text_sha256"))
