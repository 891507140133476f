"""Explicit schemas of landed inputs and of the state tables."""

from pyspark.sql import types as T

LISTING_PAGES = T.StructType([
    T.StructField("page_no", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ISSUE_BODIES = T.StructType([
    T.StructField("issue_id", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Bodies as landed, repeats included. An unknown time counts as earlier than any other.
LANDED_BODIES = T.StructType([*ISSUE_BODIES.fields, T.StructField("landed_at", T.TimestampType())])

PAGE_TEXTS = T.StructType([
    T.StructField("issue_id", T.StringType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("page_text", T.StringType()),
])

REPORTED_ITEMS = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("issue_number", T.StringType()),
    T.StructField("issue_date", T.DateType()),
    T.StructField("anchor", T.StringType()),
    T.StructField("dedup_key", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("matched_topics", T.ArrayType(T.StringType())),
    T.StructField("one_line_summary", T.StringType()),
    T.StructField("expansion", T.StringType()),
    T.StructField("key_dates", T.ArrayType(T.StringType())),
    T.StructField("action_items", T.ArrayType(T.StringType())),
    T.StructField("justification_url", T.StringType()),
    T.StructField("reported_at", T.TimestampType()),
])

ISSUE_PROGRESS = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("issue_id", T.StringType()),
    T.StructField("issue_date", T.DateType()),
    T.StructField("items_classified", T.LongType()),
    T.StructField("items_relevant", T.LongType()),
    T.StructField("processed_at", T.TimestampType()),
])

# Issues that a run saw and could not finish: they enter the next run, whatever its window.
OPEN_ISSUES = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("issue_id", T.StringType()),
    T.StructField("issue_number", T.StringType()),
    T.StructField("issue_date", T.DateType()),
    T.StructField("has_justification", T.BooleanType()),
    T.StructField("view_url", T.StringType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("justification_url", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("seen_at", T.TimestampType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("next_try", T.TimestampType()),
])

# Bodies of open issues that came by a stream, which delivers them once.
OPEN_BODIES = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("issue_id", T.StringType()),
    T.StructField("issue_date", T.DateType()),
    T.StructField("html", T.StringType()),
    T.StructField("seen_at", T.TimestampType()),
])

RUN_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("run_date", T.DateType()),
    T.StructField("run_ts", T.TimestampType()),
    T.StructField("window_start", T.DateType()),
    T.StructField("window_end", T.DateType()),
    T.StructField("issues_scanned", T.LongType()),
    T.StructField("candidates", T.LongType()),
    T.StructField("failures", T.LongType()),
    T.StructField("relevant", T.LongType()),
    T.StructField("new_items", T.LongType()),
    T.StructField("persisted", T.LongType()),
    T.StructField("report_path", T.StringType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("skipped", T.LongType()),
    T.StructField("capped", T.LongType()),
    T.StructField("dropped", T.LongType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("has_mail", T.BooleanType()),
])

# Keys of the scorer's JSON reply. Fixed values.
SCORE_REPLY_KEYS = (
    "is_relevant", "score", "matched_topics", "one_line_summary_hu", "reasoning_hu",
)
ENRICH_REPLY_KEYS = ("expansion_hu", "key_dates_hu", "action_items_hu")
