"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawtide.functions.binding import let
from lawtide.llm import (
    backoff, chat, exact, language, line_chunks, merkle, minhash, mixing, page_text, periodic, phrase_index, substrings,
    url_rules)
from lawtide.sources.workspace import Stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(
        table(spark, folder, "documents"), Stage(spark), shingle=3, percent=85, bands=32)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    told = phrase_index.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), Stage(spark))
    return told.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    told = substrings.repeated_passages(table(spark, folder, "documents"), Stage(spark), words=13, longest=False)
    return told.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = backoff.backoff_scores(table(spark, folder, "documents"), Stage(spark))
    return scored.select("doc_id", "n_words", "logprob")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"), Stage(spark), digest_all=True)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = line_chunks.line_dedup(table(spark, folder, "documents"), Stage(spark))
    return left.select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = page_text.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    told = language.identified(docs.select("doc_id", "text"), language.train(docs))
    return told.select(
        "row.doc_id", language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixed_sources(table(spark, folder, "documents"), Stage(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    says = f"{chat.END}{chat.START}assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat.read_back(chat.chat_windows(turns.unionByName(probe)))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = docs.withColumn("text", F.when(
        h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))).otherwise(F.col("text")))
    found = periodic.periodic_runs(made)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return (
        found.withColumns({"best": best, "listed": listed})
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
            F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
            F.sha2(F.when(F.col("listed") == "", "").otherwise(F.concat("listed", F.lit("\n"))), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256")))


#: (host, path, verdict) of the checked rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op12_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    told = url_rules.url_verdicts(table(spark, folder, "pages").select("page_id", "url"), rules, Stage(spark))
    return told.select("row.page_id", "host", "path", "rule", "verdict")


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    less = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select(
        "doc_id", "source", merkle.leaf(*fields).alias("leaf"), merkle.leaf(*fields[:-1], less).alias("tampered"))
    told = merkle.manifest(rows, Stage(spark))
    return told.withColumn("folded_root", merkle.folded(F.col("row.tampered"), F.col("proof"))).select(
        "row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_decontamination, op3_substring_dedup, op4_lm_scoring, op5_exact_dedup, op6_line_dedup,
    op7_html_text, op8_language_id, op9_mixing, op10_chat_format, op11_periodic_runs, op12_url_filters, op13_merkle)}
