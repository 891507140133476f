"""Mixing sources to target weights with hash thresholds.

Every document has a hash. A source takes whole passes over its documents plus those whose hash is
below a threshold. Thresholds come from histograms: sizes are summed by source and hash bucket, the
bucket in which a budget runs out is found from running sums over the buckets, and that bucket alone is
cut into finer ones, until it holds one hash. Nothing is sorted by hash, and what is summed per
source is a fixed number of buckets, however many documents it has. Thresholds of smaller budgets
lie below those of larger ones, so mixes of several budgets are nested.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawtide.llm.words import SPACED, slices, words_of
from lawtide.sources.workspace import Stage

#: Hashes have so many bits; a histogram splits by so many at a time.
HASH_BITS, STEP_BITS = 60, 10


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            part = batch.slice(a, b - a)
            size = words_of(part["text"], SPACED, lower=False).counts
            yield pa.RecordBatch.from_arrays(
                [part["id"], part["source"], pa.array(size, pa.int64()), part["hash"]],
                ["id", "source", "size", "hash"])


def row_hash(id_col: str, text_col: str) -> Column:
    """The hash that decides on a row."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), 64 - HASH_BITS)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, hash) of every row; size is the number of words of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        text.alias("text"), row_hash(id_col, text_col).alias("hash"),
    ).mapInArrow(_counted, f"id {kind}, source string, size long, hash long")


def ranked_sources(rows: DataFrame, stage: Stage, weights: Sequence[float]) -> DataFrame:
    """(source, rank, weight, size): sources by code point, null last, weights repeating.

    Ranks come from a distributed sort: the place within a partition plus the rows of the partitions
    before it, so there may be any number of sources.
    """
    placed = stage(
        rows.groupBy("source").agg(F.sum("size").alias("size"))
        .orderBy(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id()), "sources_placed")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (  # a row for each partition of the sort
        placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        .withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return stage(
        placed.withColumn("part", part).join(parts, "part")
        .withColumn("rank", F.col("skip") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .select("source", "rank", "size",
                F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")),
        "sources")


def targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """Adds target: budget times all sizes, shared by weight; a share above `most` times its
    source's size stops there, and the excess is shared by weight among the others until none is
    above. Only sums over the sources reach the driver, a few numbers in each turn."""
    cap, level = F.col("size") * float(most), None
    asked = budget * (sources.agg(F.sum("size").alias("s")).first()["s"] or 0)
    full = F.lit(False)
    stopped = -1
    while True:
        sums = sources.agg(
            F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("stopped")).first()
        if sums["stopped"] == stopped or not sums["weight"]:
            break
        stopped = sums["stopped"]
        level = (asked - (sums["held"] or 0.0)) / sums["weight"]
        full = cap <= F.col("weight") * level
    share = F.lit(0.0) if level is None else F.least(cap, F.col("weight") * level)
    return sources.withColumn("target", share)


def thresholds(rows: DataFrame, wanted: DataFrame, stage: Stage) -> DataFrame:
    """(rank, mix, below): rows of the source whose hash is under `below` sum up to about `rest`.

    rows: (rank, size, hash). wanted: (rank, mix, rest double). The row at which the sum would pass
    `rest` is taken where that comes nearer to it.
    """
    shift = HASH_BITS - STEP_BITS
    open_ = wanted.select("rank", "mix", "rest", F.lit(0).cast("long").alias("prefix"))
    kept, level = [], 0
    inside = rows
    while True:
        bucket = F.shiftright("hash", shift)
        sums = (
            inside.groupBy("rank", bucket.alias("bucket"))
            .agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high")))
        sums = stage(sums, f"histogram_{level}")
        order = Window.partitionBy("rank", "mix").orderBy("bucket")
        running = (
            open_.join(sums, "rank")
            .where(F.shiftright("bucket", STEP_BITS) == F.col("prefix") if level else F.lit(True))
            .withColumn("upto", F.sum("size").over(order))
            .withColumn("left", F.col("rest") - F.col("upto") + F.col("size")))
        edge = stage(
            running.where(F.col("upto") > F.col("rest"))
            .withColumn("n", F.row_number().over(order)).where("n = 1")
            .select("rank", "mix", "bucket", "left", "size", "low", "high"), f"edge_{level}")
        whole = stage(
            open_.join(edge.select("rank", "mix"), ["rank", "mix"], "left_anti").select("rank", "mix"),
            f"whole_{level}")
        kept.append(whole.withColumn("below", F.lit(1 << HASH_BITS)))
        one = F.col("low") == F.col("high")
        kept.append(edge.where(one).select(
            "rank", "mix", F.when(F.col("left") * 2 >= F.col("size"), F.col("low") + 1)
            .otherwise(F.col("low")).alias("below")))
        open_ = edge.where(~one).select(
            "rank", "mix", F.col("left").alias("rest"), F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
        level += 1
        inside = inside.join(
            open_.select("rank", F.col("prefix").alias("bucket")).distinct()
            .withColumnRenamed("rank", "of"),
            (F.col("rank") == F.col("of")) & (bucket == F.col("bucket"))).select("rank", "size", "hash")
        inside = stage(inside, f"inside_{level}")
        shift -= STEP_BITS
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return stage(out, "thresholds")


def mixed_sources(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", *, weights: Sequence[float] = (1, 2, 3),
    budgets: Sequence[float] = (1.0,), most: int = 3,
) -> DataFrame:
    """One row per row of docs and budget: the id, mix (index of the budget), size, source_size,
    target (its source's), copies, taken = size * copies, and the row's hash (`row_hash`).

    A budget is a share of all words. copies is the number of whole passes over the source, plus
    one where the row's hash is under the source's threshold; it never exceeds `most`. The taken
    words of a source differ from its target by half the size of one document at most (of one set
    of rows that repeat an id and a text, as these share a hash). The same rows give the same mix.

    null or blank texts have size 0 and take no words; a null source is a source, the last one;
    rows that repeat an id count each. An empty table gives no rows. Other columns are not read.
    """
    rows = stage(sized(docs, id_col, text_col, source_col), "sized")
    sources = ranked_sources(rows, stage, weights)
    plan = None
    for mix, budget in enumerate(budgets):
        one = targets(sources, budget, most).withColumn("mix", F.lit(mix))
        plan = one if plan is None else plan.unionByName(one)
    passes = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most)))
    plan = stage(
        plan.withColumn("passes", F.coalesce(passes, F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("size"))), "plan")
    ranked = stage(
        rows.join(sources.select(F.col("source").alias("of"), "rank"),
                  F.col("source").eqNullSafe(F.col("of"))).drop("of", "source"), "ranked")
    below = thresholds(
        ranked.select("rank", "size", "hash"),
        plan.where("size > 0").select("rank", "mix", "rest"), stage)
    drawn = stage(
        plan.select("rank", "mix", F.col("size").alias("source_size"), "target", "passes")
        .join(below, ["rank", "mix"], "left"), "drawn")
    more = (F.col("hash") < F.coalesce("below", F.lit(0))) & (F.col("passes") < most)
    return (
        ranked.join(drawn, "rank")
        .withColumn("copies", F.col("passes") + more.cast("long"))
        .select(F.col("id").alias(id_col), "mix", "size", "source_size", "target", "copies",
                (F.col("size") * F.col("copies")).alias("taken"), "hash"))
