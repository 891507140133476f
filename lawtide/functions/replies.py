"""Strict reading of a model's JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawtide.functions.binding import let
from lawtide.functions.text import WHITESPACE, WS, strip

FENCE = rf"(?i)^```(?:json)?{WS}*|{WS}*```$"
# Numeric text; Java alone would also take a type letter as in "0.8d".
NUMERAL = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
# Limits stated to the model.
RELEVANT_FROM = 0.50
MAX_SUMMARY, MAX_EXPANSION, MAX_ACTION = 140, 600, 120
MIN_ACTIONS, MAX_ACTIONS = 1, 3


def unfenced(reply: Column) -> Column:
    return strip(F.regexp_replace(strip(reply), FENCE, ""))


def brace_span(text: Column) -> Column:
    """From the first "{" to the last "}", NULL without both."""
    return let(F.regexp_extract(text, r"(?s)\{.*\}", 0), lambda span: F.when(span != "", span))


def single_value(text: Column) -> Column:
    """The JSON value that is all of `text`, else NULL.

    Read as the one element of an array, which is strict: no trailing text, no
    single quotes, no raw line breaks.
    """
    def only(values: Column) -> Column:
        several = F.schema_of_variant(F.try_variant_get(values, "$[1]", "variant")).isNotNull()
        return F.when(~several, F.try_variant_get(values, "$[0]", "variant"))
    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), only)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def reply_object(reply: Column) -> Column:
    """Reply as a variant object: the whole text, else its brace span, else NULL.

    A whole text that is valid JSON but no object is a failure.
    """
    def object_only(value: Column) -> Column:
        return F.when(is_object(value), value)

    def read(body: Column) -> Column:
        return let(single_value(body), lambda whole: F.when(
            whole.isNotNull(), object_only(whole)).otherwise(
            let(single_value(brace_span(body)), object_only)))
    return let(unfenced(reply), read)


def _field(obj: Column, name: str, spark_type: str = "variant") -> Column:
    return F.try_variant_get(obj, f"$.{name}", spark_type)


def _kind(obj: Column, name: str) -> Column:
    """Type of a field: NULL when absent, VOID for a JSON null."""
    return F.schema_of_variant(_field(obj, name))


def _truth(obj: Column, name: str) -> Column:
    """Empty, zero, null and absent count as false, everything else as true."""
    kind = _kind(obj, name)
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", _field(obj, name, "boolean"))
        .when(kind == "STRING", _field(obj, name, "string") != "")
        .when(F.startswith(kind, F.lit("ARRAY")), F.size(_field(obj, name, "array<variant>")) > 0)
        .when(F.startswith(kind, F.lit("OBJECT")), kind != "OBJECT<>")
        .otherwise(_field(obj, name, "double") != 0)
    )


def _text(obj: Column, name: str, default: Column) -> Column:
    return F.coalesce(_field(obj, name, "string"), default)


def _list(obj: Column, name: str) -> Column:
    return F.coalesce(_field(obj, name, "array<string>"), F.array().cast("array<string>"))


def clamped_score(obj: Column) -> Column:
    """Number or numeric text, else 0.0, limited to [0, 1]. The default comes before the clamp."""
    written = F.trim(_field(obj, "score", "string"), F.lit(WHITESPACE))
    number = F.when(_kind(obj, "score") == "STRING", F.when(
        written.rlike(NUMERAL), written.try_cast("double"))).otherwise(_field(obj, "score", "double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def score_fields(obj: Column) -> dict[str, Column]:
    """Columns of a scoring reply with defaults for what is missing."""
    return {
        "is_relevant": F.coalesce(_truth(obj, "is_relevant"), F.lit(False)),
        "score": clamped_score(obj),
        "matched_topics": _list(obj, "matched_topics"),
        "one_line_summary": _text(obj, "one_line_summary_hu", F.lit("")),
        "reasoning": _text(obj, "reasoning_hu", F.lit("")),
    }


def enrich_fields(obj: Column, summary: Column) -> dict[str, Column]:
    """Columns of an enrichment reply; the text falls back to the summary."""
    return {
        "expansion": _text(obj, "expansion_hu", F.coalesce(summary, F.lit(""))),
        "key_dates": _list(obj, "key_dates_hu"),
        "action_items": _list(obj, "action_items_hu"),
    }


def score_checks(relevant: Column, score: Column, topics: Column, summary: Column) -> dict[str, Column]:
    """True where a reply breaks what the model was told."""
    return {
        "bad_flag": relevant != (score >= RELEVANT_FROM),
        "bad_topics": ~relevant & (F.size(topics) > 0),
        "bad_summary": F.length(summary) > MAX_SUMMARY,
    }


def enrich_checks(expansion: Column, actions: Column) -> dict[str, Column]:
    return {
        "bad_expansion": F.length(expansion) > MAX_EXPANSION,
        "bad_action": F.exists(actions, lambda a: F.length(a) > MAX_ACTION),
        "bad_action_count": ~F.size(actions).between(MIN_ACTIONS, MAX_ACTIONS),
    }
