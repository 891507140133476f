"""Model calls: a batch hook for any scorer, one repair pass, error columns, defaults."""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawtide.functions import replies
from lawtide.functions.binding import computed_once
from lawtide.functions.dates import DATE_TEXT
from lawtide.functions.lexicon import HR_SCOPE, Scope
from lawtide.functions.requests import enrich_request, repair_request, score_request
from lawtide.functions.text import squeeze
from lawtide.operators.paragraphs import with_note
from lawtide.operators.prefilter import tag_topics
from lawtide.sources.workspace import Stage

# Texts in, one reply per text out, same order. An Exception in place of a reply
# marks that one call as failed.
Scorer = Callable[[list[str]], list[object]]
# Called once for every call that a task may have in flight, so clients and models are set up once and
# no scorer is used by two threads.
ScorerFactory = Callable[[], Scorer]

# A call that the service asks to repeat later is repeated so often, after waits from FIRST_WAIT on
# that double, before it counts as failed.
MOST_TRIES, FIRST_WAIT, LONGEST_WAIT = 6, 0.5, 30.0


class Overloaded(Exception):
    """Raised by a scorer for a list it has not answered at all: ask again, after `wait` seconds if given."""

    def __init__(self, message: str = "overloaded", wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


class Gate:
    """When the next call may start: a wait that one call is told holds for all calls of the task."""

    def __init__(self) -> None:
        self._lock, self._opens = threading.Lock(), 0.0

    def pause(self, seconds: float) -> None:
        with self._lock:
            self._opens = max(self._opens, time.monotonic() + seconds)

    def enter(self) -> None:
        while (left := self._opens - time.monotonic()) > 0:
            time.sleep(left)

# Error texts.
CALL_FAILED = "llm_call_failed: "
REPAIR_CALL_FAILED = "parse_failed: "
STILL_BROKEN = "parse_failed_after_repair"


def request_id(*identity: Column) -> Column:
    """Stable id of a request, from the columns that identify its paragraph."""
    return F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in identity]), 256)


def _answers(scorer: Scorer, texts: list[str], gate: Gate) -> list[object]:
    for turn in range(MOST_TRIES):
        gate.enter()
        try:
            answers = list(scorer(texts))
            break
        except Overloaded as error:
            if turn == MOST_TRIES - 1:
                return [error] * len(texts)
            gate.pause(min(LONGEST_WAIT, FIRST_WAIT * 2 ** turn) if error.wait is None else error.wait)
        except Exception as error:
            if len(texts) == 1:
                return [error]
            # One bad text must not fail its batch: halves narrow it down. A scorer that gives an
            # Exception in place of a reply is never asked again.
            half = len(texts) // 2
            return _answers(scorer, texts[:half], gate) + _answers(scorer, texts[half:], gate)
    if len(answers) != len(texts):
        raise ValueError(f"scorer gave {len(answers)} replies for {len(texts)} texts")
    return answers


REPLIES = T.StructType([
    T.StructField("request_id", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("reply", "error_type", "error_text")]])


def in_order(
    lists: Iterable[list[str]], make_scorer: ScorerFactory, in_flight: int,
) -> Iterator[tuple[list[str], list[object]]]:
    """The lists with their answers, in the order of the lists, `in_flight` of them asked at a time.

    As many lists again may be answered and wait for an earlier one; no more are read ahead.
    """
    gate, own = Gate(), threading.local()

    def setup() -> None:
        own.scorer = make_scorer()

    with ThreadPoolExecutor(in_flight, initializer=setup) as pool:
        asked: deque = deque()
        for texts in lists:
            if len(asked) == 2 * in_flight:
                first, answer = asked.popleft()
                yield first, answer.result()
            asked.append((texts, pool.submit(lambda texts=texts: _answers(own.scorer, texts, gate))))
        for first, answer in asked:
            yield first, answer.result()


def call_model(
    requests: DataFrame, make_scorer: ScorerFactory, concurrency: int, requests_per_call: int = 64,
    in_flight: int = 1,
) -> DataFrame:
    """(request_id, reply, error_type, error_text) of (request_id, request).

    `concurrency` tasks run at a time, each with `in_flight` calls under way; a scorer gets at most
    `requests_per_call` texts at once. Only ids and requests go through Python.
    """
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: deque = deque()

        def lists() -> Iterator[list[str]]:
            for batch in batches:
                for at in range(0, len(batch), requests_per_call):
                    part = batch.slice(at, requests_per_call)
                    ids.append(part["request_id"])
                    yield part["request"].to_pylist()

        for _, answers in in_order(lists(), make_scorer, in_flight):
            failed = [isinstance(a, Exception) for a in answers]
            columns = [
                [None if bad else "" if a is None else str(a) for a, bad in zip(answers, failed)],
                [type(a).__name__ if bad else None for a, bad in zip(answers, failed)],
                [str(a) if bad else None for a, bad in zip(answers, failed)],
            ]
            yield pa.RecordBatch.from_arrays(
                [ids.popleft(), *(pa.array(c, pa.string()) for c in columns)], names=REPLIES.names)

    return requests.select("request_id", "request").repartition(concurrency).mapInArrow(ask, REPLIES)


def call_in_waves(
    requests: DataFrame, make_scorer: ScorerFactory, concurrency: int, stage: Stage,
    name: str, calls_per_task: int = 10_000, requests_per_call: int = 64, in_flight: int = 1,
) -> DataFrame:
    """`call_model`, staged, so that the model is asked once per request whatever is read.

    Few tasks run at a time, so a large input would make long tasks and a lost one
    would repeat many calls. It is cut into waves of bounded tasks instead, each
    written before the next starts. `requests` come from a staged table, which makes
    counting them cheap.
    """
    waves = max(1, math.ceil(requests.count() / (concurrency * calls_per_task)))
    wave = F.pmod(F.xxhash64("request_id"), F.lit(waves))
    cut = stage(requests.withColumn("wave", wave), f"{name}_waves", partition_by="wave")
    for n in range(waves):
        stage(call_model(cut.where(F.col("wave") == n), make_scorer, concurrency, requests_per_call, in_flight),
              f"{name}_replies/wave={n}")
    paths = [stage.path(f"{name}_replies/wave={n}") for n in range(waves)]
    return requests.sparkSession.read.schema(REPLIES).parquet(*paths)


def ask_with_repair(
    rows: DataFrame, request: Column, kind: str, make_scorer: ScorerFactory,
    concurrency: int, stage: Stage, calls_per_task: int = 10_000, requests_per_call: int = 64,
    notes: DataFrame | None = None, in_flight: int = 1,
) -> DataFrame:
    """Rows with the reply as a variant object `parsed` (NULL if it failed) and `error`.

    Rows are staged under a request id and joined with their replies by it. Only requests
    whose reply did not parse are asked again. With `notes`, the note of the issue is joined to
    make the request and is not kept with the row.
    """
    def asked(requests: DataFrame, name: str) -> DataFrame:
        return call_in_waves(requests, make_scorer, concurrency, stage, name, calls_per_task, requests_per_call, in_flight)

    known = stage(rows.withColumn("request_id", F.monotonically_increasing_id()), f"{kind}_rows")
    called = F.col("error_type").isNull()
    told = known if notes is None else with_note(known, notes)
    first = stage(
        asked(told.select("request_id", request.alias("request")), kind)
        .withColumn("broken", called & replies.reply_object(F.col("reply")).isNull()), f"{kind}_first")
    second = asked(
        first.where("broken").select("request_id", repair_request(F.col("reply"), kind).alias("request")),
        f"{kind}_repair")
    settled = first.where("NOT broken").select(
        "request_id", "reply", F.lit(False).alias("repaired"),
        F.when(~called, F.concat(F.lit(CALL_FAILED), "error_text")).alias("error"))
    repaired = second.select(
        "request_id", "reply", F.lit(True).alias("repaired"),
        F.when(~called, F.concat(F.lit(REPAIR_CALL_FAILED), "error_type", F.lit(": "), "error_text")).alias("error"))
    read = computed_once(
        known.join(settled.unionByName(repaired), "request_id"), parsed=replies.reply_object(F.col("reply")))
    unread = F.col("repaired") & F.col("error").isNull() & F.col("parsed").isNull()
    return read.withColumn("error", F.when(unread, F.lit(STILL_BROKEN)).otherwise(F.col("error"))).drop(
        "request_id", "reply", "repaired")


def scored_columns(asked: DataFrame) -> DataFrame:
    """Scoring fields from `parsed`; a failed row is not relevant, score 0."""
    fields = replies.score_fields(F.col("parsed"))
    return asked.select("*", *[c.alias(n) for n, c in fields.items()]).drop("parsed")


def enriched_columns(asked: DataFrame) -> DataFrame:
    """Enrichment fields from `parsed`; a failed row keeps its summary as the text."""
    fields = replies.enrich_fields(F.col("parsed"), F.col("one_line_summary"))
    return asked.select("*", *[c.alias(n) for n, c in fields.items()]).drop("parsed")


def score(
    candidates: DataFrame, make_scorer: ScorerFactory, concurrency: int,
    stage: Stage, calls_per_task: int = 10_000, requests_per_call: int = 64,
    notes: DataFrame | None = None, in_flight: int = 1,
) -> DataFrame:
    """Score candidate paragraphs (`text`, and `justification_text` of their own or of `notes`) with a model."""
    request = score_request(F.col("text"), F.col("justification_text"))
    return scored_columns(ask_with_repair(
        candidates, request, "score", make_scorer, concurrency, stage, calls_per_task, requests_per_call, notes, in_flight))


def enrich(
    items: DataFrame, make_scorer: ScorerFactory, concurrency: int,
    stage: Stage, calls_per_task: int = 10_000, requests_per_call: int = 64, in_flight: int = 1,
) -> DataFrame:
    """Enrich new items with a longer text, key dates and action items."""
    request = enrich_request(*[F.col(n) for n in (
        "anchor", "score", "matched_topics", "one_line_summary", "text",
        "justification_text", "justification_url")])
    return enriched_columns(ask_with_repair(
        items.drop("error"), request, "enrich", make_scorer, concurrency, stage, calls_per_task,
        requests_per_call, in_flight=in_flight))


def lexical_score(topics: Column) -> Column:
    """0.4 for a hit without topic, 0.2 more per topic, at most 1."""
    return F.least(F.lit(10), F.lit(4) + F.lit(2) * F.size(topics)) / F.lit(10.0)


def lexical_scores(
    candidates: DataFrame, scope: Scope = HR_SCOPE, context: str | None = "justification_text",
    found: Sequence[str] = (),
) -> DataFrame:
    """Default scorer without a model: topics by stems, score by their number.

    `context` is searched with the text. `found` are columns of topics (NULL: no hit) where the search is
    done already: it is not repeated.
    """
    if found:
        none = F.array().cast("array<string>")
        every = F.flatten(F.array(*[F.coalesce(c, none) for c in found]))
        tagged = candidates.withColumn("matched_topics", F.array_sort(F.array_distinct(every)))
    else:
        tagged = tag_topics(candidates, scope, "text", context, out="matched_topics")
    scored = tagged.withColumn("score", lexical_score(F.col("matched_topics")))
    return scored.select(
        *candidates.columns,
        (F.col("score") >= F.lit(float(scope.threshold))).alias("is_relevant"), "score",
        "matched_topics",
        F.substring(squeeze(F.col("text")), 1, replies.MAX_SUMMARY).alias("one_line_summary"),
        F.lit("").alias("reasoning"), F.lit(None).cast("string").alias("error"))


def lexical_enrichment(items: DataFrame) -> DataFrame:
    """Default enrichment without a model: the summary, and the dates the text names."""
    return items.drop("error").select(
        "*", F.col("one_line_summary").alias("expansion"),
        F.regexp_extract_all("text", F.lit(DATE_TEXT), F.lit(0)).alias("key_dates"),
        F.array().cast("array<string>").alias("action_items"),
        F.lit(None).cast("string").alias("error"))


def attach_replies(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Replies landed by an outside batch service, joined by request id.

    A request answered twice keeps one reply (the least), so no row is multiplied.
    """
    one = answered.groupBy("request_id").agg(F.min("reply").alias("reply"))
    return requests.join(one, "request_id", "left")


def relevant(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("is_relevant") & (F.col("score") >= F.lit(float(threshold))))


def failed(scored: DataFrame) -> DataFrame:
    return scored.where(F.coalesce("error", F.lit("")) != "")
