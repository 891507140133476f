"""Whole runs over small landed tables."""

import json
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lawtide.config import MonitorConfig
from lawtide.functions.lexicon import HR_SCOPE, Scope
from lawtide.plans.report import in_report_order
from lawtide.plans.run import Landed, run, run_scopes
from lawtide.sources.workspace import Stage
from lawtide.state import MonitorState

DAY = date(2026, 7, 2)
NOW = datetime(2026, 7, 2, 8, 0, 0)


def entry(number, day, justified=False, name="Magyar Közlöny"):
    link = '<a href="/indoklasok/x"> »Indokolások</a>' if justified else ""
    return (
        f'<div class="fresh-row"><a href="/dokumentumok/d{number}/megtekintes">'
        f'<b itemprop="name">{name} 2026. évi {number}. szám</b></a>'
        f'<meta content="{day}" itemprop="datePublished"/>{link}</div>')


def section(mark, text):
    return f"<h2>{mark}</h2><p>{text}</p>"


@pytest.fixture
def landed(spark):
    listing = "<html><body>" + "".join([
        entry(83, "2026-07-01", True), entry(82, "2026-06-30"), entry(81, "2026-06-29"),
        entry(28, "2026-06-30", name="Hivatalos Értesítő"), entry(10, "2026-01-05"),
    ]) + "</body></html>"
    bodies = [
        ("2026/83", "<h1>83</h1>" + section("1. § (1)", "A munkavállaló bére 2026. július 1. napjától változik meg.")
         + section("1. § (2)", "A munkáltató köteles a táppénz összegét elszámolni a dolgozónak.")
         + section("2. §", "Ez a bekezdés semmiről sem szól, ami minket érdekelhetne.")),
        ("2026/82", "<html><body><div id=app></div></body></html>"),
    ]
    texts = [("2026/82", 1, "3. § A szabadság kiadásának szabályai változnak meg.\n\nrövid")]
    notes = [("2026/83", "<h1>Indokolás</h1><p>Általános indokolás szövege.</p><h2>2</h2><p>más</p>")]
    return Landed(
        spark.createDataFrame([(1, "u", listing)], "page_no long, url string, html string"),
        spark.createDataFrame(bodies, "issue_id string, html string"),
        spark.createDataFrame(texts, "issue_id string, page_no long, page_text string"),
        spark.createDataFrame(notes, "issue_id string, html string"))


@pytest.fixture
def state(spark, tmp_path):
    return MonitorState(spark, str(tmp_path / "state")).create()


def test_run_and_rerun(spark, state, landed, tmp_path):
    cfg = MonitorConfig()
    first = run(spark, cfg, state, landed, "r1", DAY, NOW, report_root=str(tmp_path / "out"))
    assert first.window == (date(2026, 6, 2), DAY)
    # Issue 81 has no content: scanned, warned about, left open.
    assert first.counts["issues_scanned"] == 3
    assert first.warnings == ["no content landed for 1 issues"]
    items = {(r.issue_id, r.anchor, r.pos): r for r in first.report_items.collect()}
    assert sorted(items) == [("2026/82", "3. §", 1), ("2026/83", "1. §", 0), ("2026/83", "1. §", 1)]
    wage = items[("2026/83", "1. §", 0)]
    assert wage.justification_text == "Általános indokolás szövege."
    assert wage.justification_url.endswith("/dokumentumok/d83/indokolas")
    assert wage.key_dates == ["2026. július 1"]
    # Both "1. §" rows are reported, the first is persisted.
    assert first.counts["new_items"] == 3 and first.counts["persisted"] == 2
    assert {r.issue_id: (r.items_classified, r.items_relevant) for r in state.progress().collect()} == {
        "2026/83": (3, 2), "2026/82": (1, 1)}
    assert state.total_reported() == 2

    # The run repeated under its id sees the state before it.
    repeated = run(spark, cfg, state, landed, "r1", DAY, NOW)
    assert repeated.counts["new_items"] == 3 and repeated.counts["persisted"] == 2
    assert state.total_reported() == 2 and state.reported().count() == 2

    # The issue without content is tried again, whatever the window; a seed looks back again.
    assert state.window(DAY, 30) == (DAY, DAY)
    again = run(spark, cfg, state, landed, "r2", DAY, NOW, seed=True)
    assert again.counts["new_items"] == 0 and again.counts["open_issues"] == 1
    assert state.total_reported() == 2
    text = [r.line for r in in_report_order(again.lines).collect()]
    assert "Új változások: 0" in text


def test_report_files(spark, state, landed, tmp_path):
    result = run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, report_root=str(tmp_path / "out"))
    path = state.run_log().first().report_path
    assert path == result.report_path and path.startswith(str(tmp_path / "out" / "run_id=r1"))
    folder = Path(path) / "run_date=2026-07-02"
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))
    assert text.splitlines() == [
        line for r in in_report_order(result.lines).collect() for line in r.line.split("\n")]
    assert text.startswith("HR Középvállalati Havi Riport\n")
    assert result.html().count() > 5 and result.outbox().first().subject.endswith(" – 3 új változás")
    assert text.index("2026. évi 83. szám (2026-07-01)") < text.index("§ 1. § — ") < text.index(
        "2026. évi 82. szám (2026-06-30)") < text.index("Forrás:")


def test_a_run_that_dies_publishes_no_report(spark, state, landed, tmp_path, monkeypatch):
    """Between the report and the commit: nothing leads to the report, and the next attempt has its own."""
    def die(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(MonitorState, "commit", die)
    with pytest.raises(KeyboardInterrupt):
        run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, report_root=str(tmp_path / "out"))
    monkeypatch.undo()
    assert len(list((tmp_path / "out" / "run_id=r1").iterdir())) == 1
    assert state.run_log().count() == 0 and state.reported().count() == 0
    result = run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, report_root=str(tmp_path / "out"))
    (row,) = state.run_log().collect()
    assert row.report_path == result.report_path and Path(row.report_path).exists()
    assert row.finished_at is not None and row.has_mail and row.errors == []


def test_dry_run_writes_nothing(spark, state, landed, tmp_path):
    result = run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, write=False,
                 report_root=str(tmp_path / "out"))
    assert result.counts["new_items"] == 3 and result.counts["persisted"] == 0
    assert result.report_path == "" and not (tmp_path / "out").exists()
    assert state.reported().count() == state.progress().count() == state.run_log().count() == 0


def test_model_run_scores_once_and_keeps_failed_issues_open(spark, state, landed, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def make_scorer():
        import uuid

        def scorer(texts):
            if len(texts) != 1:
                raise RuntimeError("one at a time")
            (calls / uuid.uuid4().hex).write_text(texts[0], encoding="utf-8")
            if "szabadság" in texts[0]:
                raise RuntimeError("down")
            if "is none" in texts[0]:
                return ['{"is_relevant": true, "score": 0.9, "one_line_summary_hu": "javított"}']
            if "táppénz" in texts[0]:
                return ['{"a "broken" reply']
            return [json.dumps({"is_relevant": True, "score": "0.8", "one_line_summary_hu": "jó"})]
        return scorer

    result = run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, make_scorer=make_scorer,
                 stage=Stage(spark, str(tmp_path / "stage")))
    assert result.counts["failures"] == 1
    scored = {r.pos: r for r in result.scored.where("issue_id = '2026/83'").collect()}
    assert scored[0].score == 0.8 and scored[1].score == 0.9
    assert scored[1].one_line_summary == "javított" and scored[1].error is None
    failed = result.scored.where("issue_id = '2026/82'").first()
    assert failed.error == "llm_call_failed: down" and failed.score == 0.0
    # Two rows + one repair + the failing one.
    assert len(list(calls.iterdir())) == 4
    assert [r.issue_id for r in state.progress().collect()] == ["2026/83"]
    log = state.run_log().first()
    assert sum(int(e.split(" x ")[0]) for e in log.errors) == log.failures > 0


LATER = date(2026, 7, 9), datetime(2026, 7, 9, 8)


def test_failed_issue_enters_the_next_run(spark, state, landed):
    def broken():
        def scorer(texts):
            return [RuntimeError("down") if "szabadság" in t else '{"is_relevant": false}' for t in texts]
        return scorer

    first = run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, make_scorer=broken)
    assert first.counts["failures"] == 1
    assert {(r.issue_id, r.reason) for r in state.open_issues("hr").collect()} == {("2026/82", "failed"), ("2026/81", "no content")}
    # The window starts at the last run and holds no issue; those left open come back.
    second = run(spark, MonitorConfig(), state, landed, "r2", *LATER)
    assert second.window == (DAY, LATER[0])
    assert second.counts["issues_scanned"] == 2 and second.counts["new_items"] == 1
    assert {r.issue_id for r in state.open_issues("hr").collect()} == {"2026/81"}


def test_issue_without_content_enters_the_next_run(spark, state, landed):
    run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW)
    late = spark.createDataFrame([("2026/81", "<h2>5. §</h2><p>A munkavállaló bére újra változik az idén.</p>")], "issue_id string, html string")
    again = Landed(landed.listing_pages, landed.bodies.unionByName(late), landed.page_texts, landed.justifications)
    second = run(spark, MonitorConfig(), state, again, "r2", *LATER)
    assert [(r.issue_id, r.anchor) for r in second.report_items.collect()] == [("2026/81", "5. §")]
    assert second.warnings == [] and state.open_issues("hr").count() == 0


def test_capped_issues_enter_the_next_runs(spark, state, landed):
    cfg = MonitorConfig(max_issues_per_run=1)
    first = run(spark, cfg, state, landed, "r1", DAY, NOW)
    assert first.counts["capped"] == 2 and first.warnings == ["2 issues are beyond the cap and stay open"]
    assert [r.issue_id for r in first.issues.collect()] == ["2026/83"]
    row = state.run_log().first()
    assert (row.issues_scanned, row.skipped, row.capped, row.dropped) == (3, 0, 2, 0)
    second = run(spark, cfg, state, landed, "r2", *LATER)
    assert [r.issue_id for r in second.issues.collect()] == ["2026/82"]
    assert {r.issue_id for r in state.open_issues("hr").collect()} == {"2026/81"}


def test_scopes_keep_their_own_state(spark, state, landed):
    tax = Scope("tax", {"leave": ("szabadság",)})
    hr = run(spark, MonitorConfig(), state, landed, "r1", DAY, NOW)
    other = run(spark, MonitorConfig(), state, landed, "t1", DAY, NOW, scope=tax)
    assert hr.counts["new_items"] == 3 and other.counts["open_issues"] == 3
    assert [(r.issue_id, r.matched_topics) for r in other.report_items.collect()] == [("2026/82", ["leave"])]
    assert state.reported(scope="tax").count() == 1 and state.reported().count() == 3


def test_scopes_of_one_run(spark, state, landed, tmp_path):
    """As runs of one scope each, with texts read once and a state, a cap and open issues of their own."""
    tax = Scope("tax", {"leave": ("szabadság",), "note": ("általános indokolás",)})
    stage = Stage(spark, str(tmp_path / "stage"))
    both = run_scopes(spark, MonitorConfig(), state, landed, "r1", DAY, NOW, [HR_SCOPE, tax], stage=stage)
    assert both["hr"].counts["new_items"] == 3 and both["hr"].run_id == "r1-hr"
    # The note hits every paragraph of its issue, and its topics are theirs.
    assert {(r.issue_id, r.pos, tuple(r.matched_topics)) for r in both["tax"].scored.collect()} == {
        ("2026/82", 1, ("leave",)), *(("2026/83", n, ("note",)) for n in range(3))}
    assert {r.scope: r.n for r in state.reported().groupBy("scope").agg(F.count("*").alias("n")).collect()} == {"hr": 2, "tax": 3}
    assert [p.name for p in (tmp_path / "stage").rglob("html_paragraphs")] == ["html_paragraphs"]
    alone = MonitorState(spark, str(tmp_path / "alone")).create()
    one = run(spark, MonitorConfig(), alone, landed, "r1", DAY, NOW, scope=tax)
    assert one.counts == both["tax"].counts
    # Notes are kept once per issue: not on staged paragraphs, nor on scored rows.
    assert "justification_text" not in one.paragraphs.columns + one.scored.columns
    assert run_scopes(spark, MonitorConfig(), state, landed, "r2", DAY, NOW, []) == {}
    with pytest.raises(ValueError):
        run_scopes(spark, MonitorConfig(), state, landed, "r2", DAY, NOW, [tax, tax])


def test_repeated_landings_count_once(spark, state, landed):
    twice = Landed(landed.listing_pages, landed.bodies.union(landed.bodies), landed.page_texts, landed.justifications.union(landed.justifications))
    assert run(spark, MonitorConfig(), state, twice, "r1", DAY, NOW).counts["new_items"] == 3


def test_listing_and_bodies_are_read_once_for_all_scopes(spark, landed, tmp_path):
    """Rows read of listing and bodies are as many for five scopes as for one."""
    def read(n):
        seen = {name: spark.sparkContext.accumulator(0) for name in ("listing_pages", "bodies")}

        def counted(name):
            table, told = getattr(landed, name), seen[name]

            def rows(batches):
                for batch in batches:
                    told.add(batch.num_rows)
                    yield batch
            return table.mapInArrow(rows, table.schema)

        watched = Landed(counted("listing_pages"), counted("bodies"), landed.page_texts, landed.justifications)
        state = MonitorState(spark, str(tmp_path / f"state{n}")).create()
        scopes = [Scope(f"s{i}", {"leave": ("szabadság",)} if i % 2 else {"pay": ("munkabér", "bér")}) for i in range(n)]
        told = run_scopes(spark, MonitorConfig(), state, watched, "r", DAY, NOW, scopes)
        return {name: a.value for name, a in seen.items()}, {s: r.counts for s, r in told.items()}

    one, alone = read(1)
    five, together = read(5)
    # Bodies: their text once, their ids once.
    assert one == five and one["bodies"] == 2 * landed.bodies.count()
    assert together["s0"] == together["s2"] == together["s4"] == alone["s0"] and together["s1"] == together["s3"]
    assert together["s1"]["candidates"] > 0


def test_every_scope_has_its_window_and_its_open_issues(spark, state, landed):
    """A scope that ran before looks at what is new, and at what it left open, beside one that never ran."""
    run(spark, MonitorConfig(), state, landed, "first", DAY, NOW)
    tax = Scope("tax", {"leave": ("szabadság",)})
    told = run_scopes(spark, MonitorConfig(), state, landed, "r", DAY, NOW, [HR_SCOPE, tax])
    assert told["hr"].window == (DAY, DAY) and told["tax"].window == (date(2026, 6, 2), DAY)
    assert [r.issue_id for r in told["hr"].issues.collect()] == ["2026/81"]
    assert told["tax"].counts["open_issues"] == 3 and told["hr"].counts["new_items"] == 0


def test_cap_by_scope(spark, state, landed):
    cfg = MonitorConfig(max_issues_per_run=1)
    told = run_scopes(spark, cfg, state, landed, "r", DAY, NOW, [HR_SCOPE, Scope("tax", {"leave": ("szabadság",)})])
    assert {s: (r.counts["open_issues"], r.counts["capped"]) for s, r in told.items()} == {"hr": (1, 2), "tax": (1, 2)}
    assert {r.scope: r.n for r in state._read("open_issues", None, None).groupBy("scope").agg(F.count("*").alias("n")).collect()} == {
        s: 2 + (not told[s].counts["paragraphs"]) for s in told}


def test_figures_are_told_by_the_job_that_writes(spark, tmp_path):
    stage, group = Stage(spark, str(tmp_path / "stage")), "figures"
    rows = spark.range(1000).repartition(7)
    spark.sparkContext.setJobGroup(group, group)
    try:
        table, told = stage.counted(rows, "rows", even=F.count_if(F.col("id") % 2 == 0))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        stage(rows, "plain")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 2 * jobs
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert told == {"rows": 1000, "even": 500} and table.count() == 1000
    for nothing in (rows.where("id < 0"), rows.join(rows.where("id < 0"), "id"), spark.createDataFrame([], rows.schema)):
        table, told = stage.counted(nothing, "none", even=F.count_if(F.col("id") % 2 == 0))
        assert told == {"rows": 0, "even": 0} and table.count() == 0
