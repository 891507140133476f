"""A corpus pipeline: language, repeated lines, near duplicates, benchmark passages, source weights.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame with the
columns of docs; the last adds the mix. Rows that repeat a doc_id share the fate of that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawtide.llm import language, line_chunks, minhash, mixing, phrase_index
from lawtide.sources.workspace import Stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: no letter at all, or a score too low."""
    told = language.identified(docs, language.train(docs))
    return told.where("accepted").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated runs of lines; a document of which nothing is left goes. n_chars follows."""
    left = line_chunks.line_dedup(docs, Stage(spark)).where("n_removed = 0 OR text != ''")
    changed = {
        "text": F.col("text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))}
    return left.select(*[
        changed.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    kept = minhash.near_duplicates(docs, Stage(spark)).where("kept").select(F.col("doc_id").alias("stays"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    told = phrase_index.contamination(docs, items, Stage(spark))
    leaks = told.where("contaminated").select(F.col("doc_id").alias("leaks"))
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leaks")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the size in words, copies to take, and words taken."""
    mixed = mixing.mixed_sources(docs, Stage(spark)).where("copies > 0")
    drawn = mixed.select(F.col("doc_id").alias("of"), "hash", "size", "copies", "taken").distinct()
    keyed = docs.withColumn("own_hash", mixing.row_hash("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own_hash") == F.col("hash"))
    return keyed.join(drawn, same).select(*docs.columns, "size", "copies", "taken")


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("source mix", mix_sources),
]

#: SQL expresses neither the trained model nor the chunks; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{i}")
    return docs
