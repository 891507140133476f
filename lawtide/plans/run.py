"""One monitoring run, from landed tables to report and state."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawtide.config import MonitorConfig
from lawtide.functions.lexicon import HR_SCOPE, Scope
from lawtide.operators import counts, dedupe, paragraphs, scoring
from lawtide.operators.ordered import first_per
from lawtide.operators.prefilter import keyword_filter_with_notes, with_tags
from lawtide.plans import report
from lawtide.sources import listing
from lawtide.sources.landed import latest_landing
from lawtide.sources.workspace import Stage
from lawtide.state import MonitorState


@dataclass(frozen=True)
class Landed:
    """Inputs of a run. Schemas in :mod:`lawtide.schemas`; justifications are bodies too."""

    listing_pages: DataFrame
    bodies: DataFrame
    page_texts: DataFrame
    justifications: DataFrame


@dataclass
class RunResult:
    run_id: str
    window: tuple[date, date]
    counts: dict[str, int]
    issues: DataFrame
    paragraphs: DataFrame
    scored: DataFrame
    report_items: DataFrame
    progress: DataFrame
    run_row: DataFrame
    lines: DataFrame
    described: DataFrame
    links: DataFrame
    cfg: MonitorConfig
    report_path: str = ""
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def html(self) -> DataFrame:
        """The report as HTML fragments."""
        return report.html_fragments(self.described, self.report_items, self.links)

    def outbox(self) -> DataFrame:
        """The message to send, if there is news."""
        return report.outbox(self.described, self.cfg)


def of_issues(landed: Landed, issues: DataFrame, as_of: datetime | None = None) -> Landed:
    """The landed documents of a run's issues, bodies and justifications in their latest landing until `as_of`."""
    ids = issues.select("issue_id")

    def only(table: DataFrame) -> DataFrame:
        return table.join(ids, "issue_id", "left_semi")
    return Landed(
        landed.listing_pages, latest_landing(only(landed.bodies), as_of), only(landed.page_texts),
        latest_landing(only(landed.justifications), as_of))


def fetched(landed: Landed) -> DataFrame:
    """Issues for which a body or a page text was landed."""
    return landed.bodies.select("issue_id").union(landed.page_texts.select("issue_id")).distinct()


@dataclass(frozen=True)
class Worklist:
    """Issues of a run: those found, those of them that no run processed, and those within the cap.

    `sizes` are the numbers of the three, told when they were written."""

    window: tuple[date, date]
    found: DataFrame
    unprocessed: DataFrame
    issues: DataFrame
    sizes: tuple[int, int, int]


def worklists(
    cfg: MonitorConfig, state: MonitorState, listing_pages: DataFrame, run_ids: Mapping[str, str],
    run_date: date, seed: bool, stage: Stage,
) -> dict[str, Worklist]:
    """The issues of every scope (`run_ids`: its run), by one pass over listing, log and state for all.

    Issues of the scope's window and those that its earlier runs left open; then the processed ones out,
    then the cap. Rows are keyed by scope and issue and lie in a folder for each scope."""
    scopes, own, key = list(run_ids), list(run_ids.values()), ["scope", "issue_id"]
    windows = state.windows(run_date, cfg.lookback_days, seed, own, scopes)
    pages = listing.reachable_pages(listing_pages, cfg.max_listing_pages)
    entries = stage(listing.page_issues(pages, cfg.base_url), "entries")
    listed = listing.issues_by_scope(entries, windows).drop("page_no")
    columns = [c for c in listed.columns if c != "scope"]
    left_open = state.open_issues(without_run=own).where(F.col("scope").isin(scopes)).select(*listed.columns)

    def kept(rows: DataFrame, name: str) -> tuple[DataFrame, list[int]]:
        table, told = stage.counted(rows, name, "scope", **{
            f"n{i}": F.count_if(F.col("scope") == s) for i, s in enumerate(scopes)})
        return table, [told[f"n{i}"] for i in range(len(scopes))]

    found, n_found = kept(listed.unionByName(left_open.join(listed.select(*key), key, "left_anti")), "issues")
    unprocessed, n_unprocessed = kept(found.join(state.processed(own), key, "left_anti"), "unprocessed")
    issues, n_issues = unprocessed, n_unprocessed
    if cfg.max_issues_per_run is not None:
        issues, n_issues = kept(
            listing.newest_per(unprocessed, ["scope"], cfg.max_issues_per_run), "open_issues")

    def of(rows: DataFrame, scope: str) -> DataFrame:
        return rows.where(F.col("scope") == scope).select(*columns)
    return {
        s: Worklist(windows[s], of(found, s), of(unprocessed, s), of(issues, s), sizes)
        for s, *sizes in zip(scopes, n_found, n_unprocessed, n_issues)}


@dataclass(frozen=True)
class Texts:
    """What was landed for issues, parsed: paragraphs without short ones, a note per issue that has
    one, and the issues with any content.

    Paragraphs and notes come with what the lexicons of all scopes found in them (`_found`); `tags` reads
    the topics of a scope from it. `sizes` are the numbers of paragraphs and of issues with content."""

    paragraphs: DataFrame
    notes: DataFrame
    present: DataFrame
    tags: dict[str, Column]
    sizes: tuple[int, int]

    def of(self, issues: DataFrame) -> Texts:
        """The part of some issues; counting it takes a pass over its keys."""
        ids = issues.select("issue_id")
        cut = [t.join(ids, "issue_id", "left_semi") for t in (self.paragraphs, self.notes, self.present)]
        return Texts(*cut, self.tags, (cut[0].count(), cut[2].count()))


def parsed_texts(
    issues: DataFrame, landed: Landed, min_chars: int, scopes: Sequence[Scope], stage: Stage,
    as_of: datetime | None = None,
) -> Texts:
    """Texts of the given issues, each landed document read once and searched once for all scopes."""
    landed = of_issues(landed, issues, as_of)
    # Read twice, parsed once.
    html = stage(paragraphs.html_paragraphs(landed.bodies), "html_paragraphs")
    found = paragraphs.with_fallback(html, paragraphs.page_chunks(landed.page_texts))
    tagged, tags = with_tags(paragraphs.long_enough(found, min_chars), scopes)
    notes, _ = with_tags(paragraphs.justification_notes(issues, landed.justifications), scopes, "justification_text")
    kept, n_kept = stage.counted(tagged, "paragraphs")
    present, n_present = stage.counted(fetched(landed), "present")
    return Texts(kept, stage(notes, "notes"), present, tags, (n_kept["rows"], n_present["rows"]))


def run(
    spark: SparkSession, cfg: MonitorConfig, state: MonitorState, landed: Landed,
    run_id: str, run_date: date, run_ts: datetime,
    make_scorer: scoring.ScorerFactory | None = None,
    make_enricher: scoring.ScorerFactory | None = None,
    scope: Scope = HR_SCOPE, seed: bool = False, write: bool = True,
    report_root: str | None = None, stage: Stage | None = None, as_of: datetime | None = None,
) -> RunResult:
    """Run one scope once; state is kept by scope. Bodies that landed after `as_of` are not seen. `write=False` (dry run) computes everything and touches no report or state.

    Results used more than once are staged, so no model is asked twice and a lost
    executor repeats one stage. A run repeated under its own `run_id` starts from the
    state before it and overwrites what it left.
    """
    stage, state = stage or Stage(spark), state.pinned()
    work = worklists(cfg, state, landed.listing_pages, {scope.name: run_id}, run_date, seed, stage)[scope.name]
    texts = parsed_texts(work.issues, landed, cfg.min_paragraph_length, [scope], stage, as_of)
    return run_issues(
        cfg, state, work, texts, run_id, run_date, run_ts, make_scorer, make_enricher, scope, write,
        report_root, stage)


def run_scopes(
    spark: SparkSession, cfg: MonitorConfig, state: MonitorState, landed: Landed,
    run_id: str, run_date: date, run_ts: datetime, scopes: Sequence[Scope],
    make_scorer: scoring.ScorerFactory | None = None,
    make_enricher: scoring.ScorerFactory | None = None,
    seed: bool = False, write: bool = True, report_root: str | None = None, stage: Stage | None = None,
    as_of: datetime | None = None,
) -> dict[str, RunResult]:
    """`run` for several scopes on one state. Listing, bodies, page texts and justifications of all their
    issues are read and parsed once, and texts searched once for all lexicons. Every scope has its own
    window, cap, open issues and report, and its own run, `<run_id>-<scope>`."""
    stage, state = stage or Stage(spark), state.pinned()
    parts = {s.name: Stage(spark, stage.path(f"scope={s.name}")) for s in scopes}
    if len(parts) < len(scopes):
        raise ValueError("scopes of one run need different names")
    if not scopes:
        return {}
    run_ids = {s.name: f"{run_id}-{s.name}" for s in scopes}
    work = worklists(cfg, state, landed.listing_pages, run_ids, run_date, seed, stage)
    every = None
    for one in work.values():
        every = one.issues if every is None else every.unionByName(one.issues)
    # Scopes may have seen different listings of an issue: one that names a justification counts.
    every = stage(
        first_per(every, ["issue_id"], [F.desc("has_justification"), F.desc("issue_date"), F.desc("justification_url")]),
        "issues_of_all")
    texts = parsed_texts(every, landed, cfg.min_paragraph_length, scopes, stage, as_of)
    return {
        s.name: run_issues(
            cfg, state, work[s.name], texts.of(work[s.name].issues), run_ids[s.name], run_date, run_ts,
            make_scorer, make_enricher, s, write, report_root, parts[s.name])
        for s in scopes}


#: So many different errors are told in the log row, the most frequent first; all are with the scored rows.
TOLD_ERRORS = 20


def told_errors(scored: DataFrame) -> list:
    return scoring.failed(scored).groupBy("error").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "error").limit(TOLD_ERRORS).collect()


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)


def run_issues(
    cfg: MonitorConfig, state: MonitorState, work: Worklist, texts: Texts,
    run_id: str, run_date: date, run_ts: datetime,
    make_scorer: scoring.ScorerFactory | None, make_enricher: scoring.ScorerFactory | None,
    scope: Scope, write: bool, report_root: str | None, stage: Stage, bodies: DataFrame | None = None,
) -> RunResult:
    """From parsed texts to report and state. Listing runs, scope runs and micro-batches share it.

    `bodies` (issue_id, html) are those that come once: of issues left open they are kept in the state."""
    name, issues, kept, notes = scope.name, work.issues, texts.paragraphs, texts.notes
    (start, end), unprocessed = work.window, work.unprocessed
    capped = unprocessed.join(issues.select("issue_id"), "issue_id", "left_anti")

    # The cheap filters stand below the model call: nothing is pushed through it.
    hits = keyword_filter_with_notes(kept, notes, texts.tags[name], cfg.keyword_filter_enabled)
    kept, notes = kept.drop("_found"), notes.drop("_found")
    named = dedupe.with_content_hash(dedupe.with_issue(hits, issues))
    # Few literals, which prune the folders of the state.
    reported = dedupe.of_issues(state.reported(run_id, name, **state.months_and_buckets(issues)), issues)
    if cfg.dedupe_before_scoring:
        named = dedupe.unreported(named, reported, cfg.key_columns)
    if make_scorer is None:
        scored = scoring.lexical_scores(named, scope, found=["own_topics", "note_topics"])
    else:
        scored = scoring.score(
            named, make_scorer, cfg.scoring_concurrency, stage, cfg.calls_per_task, cfg.requests_per_call, notes,
            cfg.calls_in_flight)
    threshold = cfg.relevance_threshold
    scored, per_stage = stage.counted(
        scored.drop("own_topics", "note_topics"), "scored", **counts.scored_figures(threshold))
    new = scoring.relevant(scored, threshold)
    if not cfg.dedupe_before_scoring:
        new = dedupe.unreported(new, reported, cfg.key_columns)
    if cfg.dedupe_within_batch:
        new = dedupe.first_writer(new, cfg.key_columns)
    new = paragraphs.with_note(new, notes)
    if make_enricher is None:
        items = scoring.lexical_enrichment(new)
    else:
        items = scoring.enrich(
            new, make_enricher, cfg.scoring_concurrency, stage, cfg.calls_per_task, cfg.requests_per_call,
            cfg.calls_in_flight)
    items, n_items = stage.counted(items.withColumn("run_id", F.lit(run_id)), "report_items")

    # All told by the jobs that wrote the tables.
    present = texts.present
    missing = issues.join(present, "issue_id", "left_anti")
    failed = scoring.failed(scored).select("issue_id").distinct()
    (n_found, n_unprocessed, n_issues), (n_kept, n_present) = work.sizes, texts.sizes
    figures = {
        "issues_scanned": n_found, "unprocessed": n_unprocessed, "open_issues": n_issues, "paragraphs": n_kept,
        "candidates": per_stage["rows"], "failures": per_stage["failures"], "relevant": per_stage["relevant"],
        "new_items": n_items["rows"], "persisted": 0,
    }
    figures["skipped"] = n_found - n_unprocessed
    figures["capped"] = n_unprocessed - n_issues
    figures["dropped"] = figures["relevant"] - figures["new_items"]
    without = n_issues - n_present
    warnings = [text for n, text in (
        (without, f"no content landed for {without} issues"),
        (figures["capped"], f"{figures['capped']} issues are beyond the cap and stay open"),
    ) if n]

    # An issue with a failed call, without content or beyond the cap stays open for the next run.
    done = issues.join(present, "issue_id", "left_semi").join(failed, "issue_id", "left_anti")
    progress = counts.progress_rows(done, kept, items, F.lit(run_ts.replace(microsecond=0)))
    still_open = (
        capped.withColumn("reason", F.lit("capped"))
        .unionByName(missing.withColumn("reason", F.lit("no content")))
        .unionByName(issues.join(failed, "issue_id", "left_semi").withColumn("reason", F.lit("failed"))))

    # A folder of the attempt: the log row of the run is the only way to it, so a run that fails publishes nothing.
    report_path = f"{report_root}/run_id={run_id}/attempt={uuid.uuid4().hex}" if write and report_root else ""
    errors = [] if not figures["failures"] else [f"{r.n} x {r.error}" for r in told_errors(scored)]
    if write:
        figures["persisted"] = state.mark_reported(items, run_id, run_ts, tuple(cfg.key_columns), name)
        state.mark_processed(progress, run_id, name)
        opened = state.mark_open(still_open, run_id, run_ts, name, cfg.retry_after)
        if bodies is not None:
            left = opened.select("issue_id", "issue_date")
            state.keep_bodies(bodies.where("html IS NOT NULL").join(left, "issue_id"), run_id, run_ts, name)
    logged = ("issues_scanned", "candidates", "failures", "relevant", "new_items", "persisted", "skipped", "capped", "dropped")
    run_row = state.log_row(
        run_id=run_id, scope=name, run_date=run_date, run_ts=run_ts, window_start=start, window_end=end,
        report_path=report_path, warnings=warnings, errors=errors, has_mail=figures["new_items"] > 0, **{f: figures[f] for f in logged})
    described = run_row.withColumn("threshold", F.lit(float(threshold)))
    links = dedupe.link_per_label(issues)
    lines = report.report_lines(described, items, links)
    if write:
        if report_path:
            report.write_report(lines, run_row, report_path)
        state.commit(run_row.withColumn("finished_at", F.lit(utc_now())), run_id)
    return RunResult(
        run_id, (start, end), figures, issues, kept, scored, items, progress, run_row, lines,
        described, links, cfg, report_path, warnings, errors)
