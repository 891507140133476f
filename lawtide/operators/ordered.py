"""Order-dependent steps that stay distributed when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key. `order` must be a total order within a key.

    Written as row_number() = 1, which Spark plans with a group limit before the
    shuffle: every task sends at most one row per key, however hot the key is.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, block: Column, out: str,
) -> DataFrame:
    """Sum of `value` over the rows before each row of its key, in `order`.

    `block` must grow with `order` and hold a bounded number of rows per key. Only
    one total per block crosses a whole key; rows are sorted within a block.
    """
    cut = df.withColumn("_block", block).withColumn("_value", value)
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    within = cut.withColumn("_within", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return within.join(starts, [*keys, "_block"]).withColumn(
        out, F.col("_start") + F.col("_within")).drop("_block", "_value", "_start", "_within")
