"""Merge family and run totals, as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawtide.operators.dedupe import first_writer, unreported
from lawtide.operators.ordered import first_per, running_sum


def insert_if_absent(new: DataFrame, table: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of `new` to append: first of each key, keys of the table left out."""
    return unreported(first_writer(new, keys, order), table, keys)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], version: str | Sequence[str]) -> DataFrame:
    """The table after an upsert: the latest row per key, by one column or by several in turn."""
    return latest(table.unionByName(new), keys, version)


def latest(rows: DataFrame, keys: list[str], version: str | Sequence[str]) -> DataFrame:
    """The row with the greatest version per key. Several columns make a total order of rows whose
    times are equal."""
    columns = [version] if isinstance(version, str) else version
    return first_per(rows, keys, [F.desc(c) for c in columns])


def total_reported(run_log: DataFrame) -> DataFrame:
    return run_log.agg(F.coalesce(F.sum("persisted"), F.lit(0)).alias("total_reported"))


def running_total(run_log: DataFrame, grain: str = "day") -> DataFrame:
    """Total of reported items after each run: sums within a day, by day within a year, and by year.

    Only the years of the log, a few rows, are summed in one place.
    """
    day, year = F.date_trunc("day", "run_ts"), F.date_trunc("year", "run_ts")
    cut = run_log.withColumn("_day", day).withColumn("_year", year)
    within = running_sum(
        cut, ["_day"], ["run_ts", "run_id"], F.col("persisted"), F.date_trunc(grain, "run_ts"), "_before")
    days = cut.groupBy("_year", "_day").agg(F.sum("persisted").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    by_day = Window.partitionBy("_year").orderBy("_day").rowsBetween(*earlier)
    by_year = Window.orderBy("_y").rowsBetween(*earlier)
    years = days.groupBy(F.col("_year").alias("_y")).agg(F.sum("n").alias("n")).select(
        "_y", F.coalesce(F.sum("n").over(by_year), F.lit(0)).alias("_years"))
    starts = days.withColumn("_days", F.coalesce(F.sum("n").over(by_day), F.lit(0))).join(
        years, F.col("_year") == F.col("_y")).select(F.col("_day").alias("_d"), (F.col("_days") + F.col("_years")).alias("_start"))
    return within.join(starts, F.col("_day").eqNullSafe(F.col("_d"))).withColumn(
        "running_total", F.col("_start") + F.col("_before") + F.col("persisted")).drop(
        "_before", "_day", "_year", "_d", "_start")


def last_run_date(run_log: DataFrame, *by: str) -> DataFrame:
    """One row, or one per value of `by` that has runs; text that is no date counts as no run."""
    kind = run_log.schema["run_date"].dataType.typeName()
    run_date = F.try_to_date("run_date", "yyyy-MM-dd") if kind == "string" else F.col("run_date")
    return run_log.groupBy(*by).agg(F.max(run_date).alias("last_run"))


def run_meta(run_log: DataFrame) -> DataFrame:
    """Run totals as (key, value) text; a key without a value is absent."""
    both = run_log.agg(
        F.max("run_date").cast("string").alias("last_run"),
        F.sum("persisted").cast("string").alias("total_reported"))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in both.columns])
    return both.select(F.explode(pairs).alias("p")).select("p.key", "p.value").where("value IS NOT NULL")


def window_start(run_date: Column, last_run: Column, lookback_days: int) -> Column:
    """The later of the last run and the look-back; the look-back alone without a last run."""
    return F.greatest(last_run, F.date_sub(run_date, lookback_days))


def run_window(
    run_date: date, last_run: date | None, lookback_days: int, seed: bool = False,
) -> tuple[date, date]:
    """The window as plain dates, so that it reaches scans as literals. A seed ignores the last run."""
    earliest = run_date - timedelta(days=lookback_days)
    return (earliest if seed or last_run is None else max(last_run, earliest)), run_date


def reported_in_window(reported: DataFrame, start, end) -> DataFrame:
    return reported.where(F.col("issue_date").between(F.lit(start), F.lit(end))).orderBy(
        F.desc("issue_date"), F.desc("issue_number"), F.asc("anchor"))
