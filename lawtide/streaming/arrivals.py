"""Documents monitored as they land: the steps of a run, once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lawtide import schemas
from lawtide.config import MonitorConfig
from lawtide.functions.lexicon import HR_SCOPE, Scope
from lawtide.operators.ordered import first_per
from lawtide.operators.scoring import ScorerFactory
from lawtide.plans.run import Landed, Worklist, parsed_texts, run_issues
from lawtide.sources.workspace import Stage
from lawtide.state import MonitorState

#: What else an issue may come with; columns that a landed row lacks are NULL.
ISSUE_COLUMNS = ("issue_id", "issue_number", "issue_date", "has_justification", "view_url", "pdf_url", "justification_url")


def landed_issues(batch: DataFrame, justified: bool) -> DataFrame:
    """One row per issue with its html, the latest landing that has any. An issue that lands twice in
    a batch is one issue. `justified`: whether an issue that does not say so may have a justification."""
    types = {f.name: f.dataType for f in schemas.OPEN_ISSUES.fields}
    landed_at = (F.col("landed_at") if "landed_at" in batch.columns else F.lit(None)).cast("timestamp")
    full = batch.select("html", landed_at.alias("landed_at"), *[
        (F.col(c) if c in batch.columns else F.lit(None)).cast(types[c]).alias(c) for c in ISSUE_COLUMNS])
    full = full.withColumn("has_justification", F.coalesce("has_justification", F.lit(justified)))
    return first_per(full, ["issue_id"], [
        F.col("html").isNull(), F.desc("landed_at"), F.desc("issue_date"), F.desc("html"), *[F.desc(c) for c in ISSUE_COLUMNS]]).drop("landed_at")


def monitor_arrivals(
    bodies: DataFrame, state: MonitorState, checkpoint: str, name: str = "arrivals",
    cfg: MonitorConfig = MonitorConfig(), scope: Scope = HR_SCOPE,
    trigger: dict | None = None,
    make_scorer: ScorerFactory | None = None, make_enricher: ScorerFactory | None = None,
    page_texts: DataFrame | None = None, justifications: DataFrame | None = None,
    report_root: str | None = None,
) -> StreamingQuery:
    """Start the stream of bodies (issue_id, issue_number, issue_date, html, and any of ISSUE_COLUMNS).

    Each micro-batch is a run with its own id over the issues that landed, so a batch that is
    delivered again overwrites itself: every item is reported once. `page_texts` and
    `justifications` are tables, read as they are when a batch starts; page texts stand in for a
    body without paragraphs, a null html included. An issue that lands again is read again and its new
    keys are reported.

    Issues with a failed call or without content are left open in the state, with their body. They
    are a queue: each micro-batch takes those that are due (`cfg.retry_after`, longer with every attempt) along
    with what has landed, unless they land anew. `retry_open` does so when nothing lands.
    """
    step = _step(state, cfg, scope, make_scorer, make_enricher, page_texts, justifications, report_root)

    def process(batch: DataFrame, batch_id: int) -> None:
        step(batch, f"{name}-{batch_id:012d}")

    writer = bodies.writeStream.queryName(name).foreachBatch(process)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def retry_open(
    state: MonitorState, run_id: str, cfg: MonitorConfig = MonitorConfig(), scope: Scope = HR_SCOPE,
    make_scorer: ScorerFactory | None = None, make_enricher: ScorerFactory | None = None,
    page_texts: DataFrame | None = None, justifications: DataFrame | None = None,
    report_root: str | None = None,
) -> None:
    """A run over the open issues of the scope that are due, as a micro-batch in which nothing landed."""
    none = state.spark.createDataFrame([], schemas.OPEN_BODIES).select("issue_id", "issue_date", "html")
    _step(state, cfg, scope, make_scorer, make_enricher, page_texts, justifications, report_root)(none, run_id)


def _step(
    state: MonitorState, cfg: MonitorConfig, scope: Scope, make_scorer: ScorerFactory | None,
    make_enricher: ScorerFactory | None, page_texts: DataFrame | None, justifications: DataFrame | None,
    report_root: str | None,
) -> Callable[[DataFrame, str], None]:
    spark = state.spark

    def nothing(schema) -> DataFrame:
        return spark.createDataFrame([], schema)

    def step(batch: DataFrame, run_id: str) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
        stage, at_start = Stage(spark), state.pinned()
        fresh = stage(landed_issues(batch, justifications is not None), "fresh")
        due = stage(
            at_start.open_issues(scope.name, run_id, now)
            .join(fresh.select("issue_id"), "issue_id", "left_anti").select(*ISSUE_COLUMNS), "due")
        kept = at_start.open_bodies(scope.name, due, run_id)
        rows = stage(fresh.unionByName(due.join(kept, "issue_id", "left")), "landed")
        issues = rows.drop("html")
        days = rows.agg(
            F.min("issue_date").alias("first"), F.max("issue_date").alias("last"), F.count("*").alias("n")).first()
        window = (days.first or now.date(), days.last or now.date())
        bodies = rows.select("issue_id", "html")
        landed = Landed(
            nothing(schemas.LISTING_PAGES), bodies,
            nothing(schemas.PAGE_TEXTS) if page_texts is None else page_texts,
            nothing(schemas.ISSUE_BODIES) if justifications is None else justifications)
        texts = parsed_texts(issues, landed, cfg.min_paragraph_length, [scope], stage)
        run_issues(
            cfg, at_start, Worklist(window, issues, issues, issues, (days.n,) * 3), texts, run_id, window[1], now,
            make_scorer, make_enricher, scope, True, report_root, stage, bodies)
        stage.drop()

    return step
