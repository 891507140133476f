"""Readers of landed tables. Schemas are explicit, so no file is opened to infer one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawtide import schemas
from lawtide.functions.text import decode_bytes


def listing_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LISTING_PAGES).parquet(path)


def issue_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Bodies with the time they landed; files without it give nulls."""
    return spark.read.schema(schemas.LANDED_BODIES).parquet(path)


def latest_landing(bodies: DataFrame, as_of: datetime | None = None, key: str = "issue_id") -> DataFrame:
    """One body per issue (issue_id, html), however often it was landed: the latest one with a text, of
    those landed until `as_of`. Landings without a time come before all others; of equal
    times the greater text counts, so that the choice does not depend on the order of rows."""
    landed_at = F.col("landed_at") if "landed_at" in bodies.columns else F.lit(None).cast("timestamp")
    rows = bodies.where("html IS NOT NULL")
    if as_of is not None:
        rows = rows.where(landed_at.isNull() | (landed_at <= F.lit(as_of)))
    return rows.groupBy(key).agg(F.max_by("html", F.struct(landed_at.alias("at"), F.col("html").alias("text"))).alias("html"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE_TEXTS).parquet(path)


def raw_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Landed files as (path, content); decode with :func:`decoded`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return files.option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded(raw: DataFrame, content: str = "content", charset: str = "charset") -> DataFrame:
    """Replace landed bytes by their text, read by the declared charset of each row."""
    return raw.withColumn("html", decode_bytes(F.col(content), F.col(charset))).drop(content, charset)
