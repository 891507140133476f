"""Steps on small DataFrames."""

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lawtide import schemas
from lawtide.config import MonitorConfig
from lawtide.functions.lexicon import HR_SCOPE, Scope
from lawtide.operators import counts, dedupe, ordered, paragraphs, prefilter, scoring
from lawtide.plans import report
from lawtide.sources import landed, listing
from lawtide.sources.workspace import Stage
from lawtide.state import MonitorState, merge

BASE = "https://site.example"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- listing ---------------------------------------------------------------------

ROW = (
    '<div class="fresh-row wide"><span>new</span><a href="/dokumentumok/{id}/megtekintes"><b>{label}</b></a>'
    '<meta content="{day}" itemprop="datePublished"><em>{text}</em>{extra}</div>')
NOTES = '<a href="/indoklasok/n1">»Indokolások</a>'


def entry(id, label, day="", text="", extra=""):
    return ROW.format(id=id, label=label, day=day, text=text, extra=extra)


def pages(spark, *html):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(html, 1)], schemas.LISTING_PAGES)


def test_listing_drops_the_sister_bulletin(spark):
    page = (entry("q7", "Közlöny 2031. évi 12. szám", "2031-03-05", "2031. március 5.", NOTES)
            + entry("q8", "Hivatalos Értesítő 2031. évi 3. szám", "2031-03-06") + entry("q9", "Közlöny 2031. évi 11. szám", "2031-01-30"))
    found = listing.listed_issues(pages(spark, page), BASE, (date(2031, 2, 1), date(2031, 3, 31))).collect()
    assert [(i.issue_id, i.issue_date, i.has_justification) for i in found] == [("2031/12", date(2031, 3, 5), True)]
    assert found[0].justification_url == "https://site.example/dokumentumok/q7/indokolas"
    assert found[0].pdf_url == "https://site.example/dokumentumok/q7/letoltes"


def test_window_comes_before_the_last_page(spark):
    one, two = entry("a", "2031. évi 1. szám", "2031-05-01"), entry("b", "2031. évi 1. szám", "2030-05-01")
    inside = listing.listed_issues(pages(spark, one, two), BASE, (date(2031, 1, 1), date(2031, 12, 31)))
    assert rows(inside, "issue_date", "page_no") == [(date(2031, 5, 1), 1)]


def test_entry_fields_stay_within_the_entry(spark):
    page = (entry("a", "2026. évi 1. szám", "", "") + entry("b", "2026. évi 2. szám", "", "2026. május 2.", NOTES)
            + entry("c", "Melléklet", "2026-05-03"))
    assert rows(listing.listed_issues(pages(spark, page), BASE), "issue_id", "has_justification") == [("2026/2", True)]


def test_wide_listing_without_entry_boxes(spark):
    page = "".join(
        f'<li><a href="/dokumentumok/{i}/megtekintes">2026. évi {i}. szám</a> 2026. május {i}.</li>' for i in (1, 2))
    assert rows(listing.listed_issues(pages(spark, page), BASE), "issue_id", "issue_date") == [
        ("2026/1", date(2026, 5, 1)), ("2026/2", date(2026, 5, 2))]


def test_first_in_page_last_page_wins(spark):
    one = entry("a", "2026. évi 1. szám", "2026-05-01") + entry("b", "2026. évi 1. szám", "2026-05-02")
    two = entry("c", "2026. évi 1. szám", "2026-05-03") + entry("d", "2026. évi 1. szám", "2026-05-04")
    assert rows(listing.listed_issues(pages(spark, one, two), BASE), "issue_date", "page_no") == [(date(2026, 5, 3), 2)]


@pytest.mark.parametrize("html, kept", [
    (["/dokumentumok/", "/dokumentumok/", "none", "/dokumentumok/"], [1, 2, 3]),
    (["/dokumentumok/", None, "/dokumentumok/"], [1]),
    ([None, "none"], []),
    (["/dokumentumok/"] * 25, list(range(1, 26))),
])
def test_reachable_pages(spark, html, kept):
    assert [n for n, in rows(listing.reachable_pages(pages(spark, *html)), "page_no")] == sorted(kept, key=lambda n: str((n,)))


def test_newest_first_and_cap(spark):
    issues = spark.createDataFrame(
        [("2026/83", date(2026, 7, 1)), ("2026/9", date(2026, 7, 1)), ("2026/84", date(2026, 7, 2)), ("2026/1", date(2026, 1, 1))],
        "issue_id string, issue_date date")
    assert [r.issue_id for r in listing.newest(issues, 3).collect()] == ["2026/84", "2026/9", "2026/83"]
    # The cap comes before the processed ones are removed.
    progress = spark.createDataFrame([("2026/84",)], "issue_id string")
    assert rows(dedupe.unprocessed(listing.newest(issues, 2), progress), "issue_id") == [("2026/9",)]


# -- paragraphs --------------------------------------------------------------------

def body(spark, html):
    return spark.createDataFrame([("i", html)], schemas.ISSUE_BODIES)


def test_sections(spark):
    html = """<html><head><title>t</title></head><body><p>eleje</p><article><h1>2026. évi 83. szám</h1><section>
      <h2>12. § (3)</h2><p>A cégautóadó <b>mértéke</b> nő.</p><p>Vége.<p>lezáratlan
      <h3>Üres fejezet</h3><ul><li>nem bekezdés</li></ul>
      <h2>IV. fejezet</h2><div class="x bekezdes">div szövege</div><div class="y">más</div>
      <script>var t="</p><p>no</p>";</script></section></article></body></html>"""
    assert rows(paragraphs.html_paragraphs(body(spark, html)), "pos", "anchor", "heading", "text") == [
        (0, "ismeretlen", "", "eleje"),
        (1, "12. §", "12. § (3)", "A cégautóadó mértéke nő.Vége.lezáratlan"),
        (2, "IV. fejezet", "IV. fejezet", "div szövege")]


def test_boxes_keep_nested_text_once(spark):
    html = """<h1>c</h1><p>elöl</p><div class="bekezdes">a <p>b</p> c<div class="x">d</div>e<div class="bekezdes">f</div></div>g
      <p>h</p><div class='bekezdes'>i</div><div>j</div><h2>d</h2><div class="bekezdes"><ul><li>k</li><li>l</li></ul>"""
    assert rows(paragraphs.html_paragraphs(body(spark, html)), "pos", "text") == [
        (0, "elöla b c d e fhi"), (1, "k l")]


def test_body_without_paragraphs(spark):
    assert paragraphs.html_paragraphs(body(spark, "<div id=app></div><h1>x</h1>")).count() == 0
    assert paragraphs.html_paragraphs(body(spark, "")).count() == 0


def test_page_chunks_number_through_the_issue(spark):
    texts = ["a" * 29 + "\n\n" + "b" * 30, None, "\n" + "c" * 31 + "\n\n\n\n" + "d" * 40 + "\n", "", "e" * 30 + "\n\nx"]
    table = spark.createDataFrame([("i", n, t) for n, t in enumerate(texts, 1)], schemas.PAGE_TEXTS)
    assert rows(paragraphs.page_chunks(table), "pos", "text") == [
        (2, "b" * 30), (4, "c" * 31), (6, "d" * 40), (8, "e" * 30)]
    assert rows(paragraphs.page_offsets(table), "page_no", "start") == [(1, 0), (2, 63), (3, 65), (4, 142), (5, 144)]


def test_page_chunks_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "PAGES_PER_BLOCK", 3)
    texts = [f"{n:030d}" + "\n\n" * (n % 3) + "z" * (30 if n % 3 else 0) for n in range(1, 30)]
    table = spark.createDataFrame(
        [("i", n, t) for n, t in enumerate(texts, 1)] + [("j", 1, "y" * 30)], schemas.PAGE_TEXTS)
    expected, pos = [], 0
    for n in range(1, 30):
        pos += 1
        expected.append((pos, f"{n:030d}"))
        pos += n % 3
        if n % 3:
            expected.append((pos, "z" * 30))
    assert rows(paragraphs.page_chunks(table).where("issue_id = 'i'"), "pos", "text") == sorted(expected, key=str)


def test_text_chunks_anchor(spark):
    table = spark.createDataFrame([("i", "x\n\n" + "12. § " + "a" * 30 + "\n\n" + "b" * 30)], "issue_id string, page_text string")
    assert rows(paragraphs.text_chunks(table), "pos", "anchor") == [(2, "12. §"), (3, "p3")]


def test_fallback_and_justification(spark):
    bodies = spark.createDataFrame([("1", "<h1>h</h1><p>html</p>"), ("2", "<div id=app></div>")], schemas.ISSUE_BODIES)
    html = paragraphs.html_paragraphs(bodies)
    chunks = spark.createDataFrame(
        [("1", 1, "p1", "", "pdf"), ("2", 1, "p1", "", "pdf")],
        "issue_id string, pos long, anchor string, heading string, text string")
    both = paragraphs.with_fallback(html, chunks)
    assert rows(both, "issue_id", "text") == [("1", "html"), ("2", "pdf")]
    issues = spark.createDataFrame([("1", True, "u1"), ("2", False, None)], "issue_id string, has_justification boolean, justification_url string")
    notes = spark.createDataFrame([("1", "<h1>a</h1><p>első</p><h1>b</h1><p>második</p>"), ("2", "<p>nem kell</p>")], schemas.ISSUE_BODIES)
    assert rows(paragraphs.with_justification(both, issues, notes), "issue_id", "justification_text", "justification_url") == [
        ("1", "első", "u1"), ("2", "", None)]


def test_running_sum_without_keys(spark):
    df = spark.range(1, 101).select(F.col("id").alias("o"), (F.col("id") * 3).alias("v"))
    got = ordered.running_sum(df, [], ["o"], F.col("v"), F.floor(F.col("o") / 7), "s")
    assert all(r.s == 3 * (r.o - 1) * r.o // 2 for r in got.collect())


# -- lexicon steps --------------------------------------------------------------------

def test_scopes_in_one_pass(spark):
    df = spark.createDataFrame([(1, "A bér és az adó"), (2, "adózás"), (3, "semmi")], "i int, text string")
    tax = Scope("tax", {"adó": ("adó",)}, threshold=0.7)
    got = rows(prefilter.match_scopes(df, [HR_SCOPE, tax]), "i", "scope", "threshold", "topics")
    assert got == [(1, "hr", 0.5, ["2. Bér, SZJA, szocho"]), (1, "tax", 0.7, ["adó"]), (2, "tax", 0.7, ["adó"])]
    odd = Scope("odd", {"x": ("ad[óo]",)})
    assert rows(prefilter.match_scopes(df, [odd, tax]), "i", "scope") == [(1, "odd"), (1, "tax"), (2, "odd"), (2, "tax")]
    assert prefilter.keyword_filter(df, enabled=False).count() == 3


# -- scoring ---------------------------------------------------------------------------

def items(spark, n=3):
    return spark.createDataFrame(
        [(str(i), i, "12. §", 0.7, ["bér"], f"FB{i}", f"szöveg {i}", "", None) for i in range(n)],
        "issue_id string, pos long, anchor string, score double, matched_topics array<string>, "
        "one_line_summary string, text string, justification_text string, justification_url string")


def test_enrichment_repairs_and_falls_back(spark):
    def make():
        def one(request):
            if "szöveg 0" in request:
                return '{"expansion_hu": "E", "key_dates_hu": ["2026.01.01."], "action_items_hu": ["x"]}'
            if "is none" in request:
                return '{"expansion_hu": "J"}' if "1!" in request else "újra { rossz"
            return '{"expansion_hu": "a\n"b"}' + ("1!" if "szöveg 1" in request else "2!")
        return lambda texts: [one(x) for x in texts]

    got = rows(scoring.enrich(items(spark), make, 2, Stage(spark)), "issue_id", "expansion", "key_dates", "action_items", "error")
    assert got == [("0", "E", ["2026.01.01."], ["x"], None), ("1", "J", [], [], None),
                   ("2", "FB2", [], [], "parse_failed_after_repair")]


def test_call_errors(spark):
    def make():
        def scorer(texts):
            return [ValueError("nope") if "is none" in x else RuntimeError("down") if "szöveg 0" in x else "bad" for x in texts]
        return scorer

    got = rows(scoring.score(items(spark, 2).select("issue_id", "pos", "text", "justification_text"), make, 2, Stage(spark)),
               "issue_id", "is_relevant", "score", "error")
    assert got == [("0", False, 0.0, "llm_call_failed: down"), ("1", False, 0.0, "parse_failed: ValueError: nope")]


def test_scorer_is_set_up_once_per_task_and_must_answer_all(spark, tmp_path):
    def make():
        import uuid
        (tmp_path / uuid.uuid4().hex).write_text("")
        return lambda texts: ["{}"] * len(texts)

    asked = items(spark, 40).select(F.col("pos").alias("request_id"), F.col("text").alias("request"))
    called = scoring.call_model(asked, make, 3)
    assert called.rdd.getNumPartitions() == 3
    assert called.where("reply = '{}'").count() == 40 and len(list(tmp_path.iterdir())) == 3
    with pytest.raises(Exception, match="replies for"):
        scoring.call_model(asked, lambda: lambda texts: ["{}"], 1).collect()


def test_waves_ask_every_row_once(spark, tmp_path):
    def make():
        import uuid

        def scorer(texts):
            (tmp_path / uuid.uuid4().hex).write_text("\n".join(texts))
            return ["{}" if "9" in x else "broken" for x in texts]
        return scorer

    asked = items(spark, 50).select("issue_id", "pos", "text", "justification_text")
    got = scoring.score(asked, make, 2, Stage(spark), calls_per_task=5)
    assert got.columns[:4] == asked.columns and got.count() == 50 and got.select("issue_id").distinct().count() == 50
    assert got.where("error IS NOT NULL").count() == sum("9" not in str(i) for i in range(50))
    files = list(tmp_path.iterdir())
    assert len(files) > 10 and sum("is none" not in f.read_text() for f in files) >= 10
    assert sum(f.read_text().count("Bekezdés szövege:") for f in files) == 50


def test_a_failing_text_does_not_repeat_its_batch(spark, tmp_path):
    """Halves narrow a failing call down; a scorer that marks its failures is asked once per text."""
    def make(marks):
        def scorer(texts):
            import uuid
            bad = ["szöveg 5" in x for x in texts]
            if any(bad) and not marks:
                raise RuntimeError("down")
            (tmp_path / uuid.uuid4().hex).write_text("\n".join(texts))
            return [RuntimeError("down") if b else "{}" for b in bad]
        return lambda: scorer

    asked = items(spark, 16).select(F.col("pos").alias("request_id"), F.col("text").alias("request"))
    for marks in (True, False):
        got = scoring.call_model(asked, make(marks), 1, requests_per_call=16)
        assert rows(got.where("reply IS NULL"), "request_id", "error_text") == [(5, "down")]
        texts = [x for f in tmp_path.iterdir() for x in f.read_text().split("\n")]
        assert len(texts) == len(set(texts)) == (16 if marks else 15)
        for f in tmp_path.iterdir():
            f.unlink()


def test_replies_are_attached_by_id(spark):
    asked = items(spark).withColumn("request_id", scoring.request_id(F.col("issue_id"), F.col("pos"), F.col("text")))
    answers = [(r.request_id, "b") for r in asked.collect()[:2]] + [(asked.first().request_id, "a"), ("unknown", "z")]
    got = scoring.attach_replies(asked, spark.createDataFrame(answers, "request_id string, reply string"))
    assert rows(got, "issue_id", "reply") == [("0", "a"), ("1", "b"), ("2", None)]


# -- dedupe and counts ---------------------------------------------------------------------

def test_unknown_issue_gets_an_empty_number(spark):
    issues = spark.createDataFrame([("1", "n1", date(2026, 1, 1))], "issue_id string, issue_number string, issue_date date")
    found = spark.createDataFrame([("1",), ("2",)], "issue_id string")
    assert rows(dedupe.with_issue(found, issues), "issue_id", "issue_number", "issue_date") == [
        ("1", "n1", date(2026, 1, 1)), ("2", "", None)]


def test_last_label_in_report_order_gives_the_link(spark):
    issues = spark.createDataFrame(
        [("2", "n", date(2026, 1, 2), "new"), ("1", "n", date(2026, 1, 1), "old"), ("3", "", date(2026, 1, 1), "x")],
        "issue_id string, issue_number string, issue_date date, view_url string")
    assert rows(dedupe.link_per_label(issues), "issue_number", "url") == [("n", "old")]


def test_grouped_items_are_ranked_in_anchor_order(spark):
    table = spark.range(0, 2500).select(
        F.lit("n").alias("issue_number"), F.lit(date(2026, 1, 1)).alias("issue_date"),
        F.concat(F.lit("p"), F.col("id") % 10).alias("anchor"), F.col("id").alias("pos"))
    ranked = counts.grouped_items(table).orderBy("item_rank").collect()
    keys = [(i.anchor, i.pos) for i in ranked]
    assert keys == sorted(keys) and [i.item_rank for i in ranked] == list(range(1, 2501))


# -- state -------------------------------------------------------------------------------

def reported(spark, *keys, issue_id="2026/1"):
    return spark.createDataFrame(
        [(issue_id, i, "n", date(2026, 1, 1), a, h, 0.8, ["bér", "őrség"], "s", "e", ["d1", "d2"], ["a1"], None)
         for i, (a, h) in enumerate(keys)],
        "issue_id string, pos long, issue_number string, issue_date date, anchor string, content_hash string, score double, "
        "matched_topics array<string>, one_line_summary string, expansion string, key_dates array<string>, "
        "action_items array<string>, justification_url string")


def run_row(spark, run_id, day, persisted):
    return spark.createDataFrame([(run_id, "hr", day, datetime(day.year, day.month, day.day), day, day,
                                   1, 1, 0, 1, 1, persisted, "", ["w"], [], 0, 0, 0, None, False)], schemas.RUN_LOG)


NOW = datetime(2026, 1, 1, 12, 0, 0, 500)


def test_state_insert_refuses_known_keys(spark, tmp_path):
    state = MonitorState(spark, str(tmp_path / "s")).create()
    assert state.reported().count() == 0 and state.window(date(2026, 1, 31), 30) == (date(2026, 1, 1), date(2026, 1, 31))
    assert state.mark_reported(reported(spark, ("1. §", "h1"), ("1. §", "h2"), ("2. §", "h3")), "r1", NOW) == 2
    # Not committed yet: nothing to read.
    assert state.reported().count() == 0
    state.commit(run_row(spark, "r1", date(2026, 1, 20), 2), "r1")
    row = state.reported().where("anchor = '1. §'").first()
    assert row.dedup_key == "n::1. §" and row.content_hash == "h1" and row.key_dates == ["d1", "d2"]
    assert row.matched_topics == ["bér", "őrség"] and row.reported_at == datetime(2026, 1, 1, 12, 0, 0)
    assert state.mark_reported(reported(spark, ("1. §", "h9"), ("3. §", "h3")), "r2", NOW) == 1
    state.commit(run_row(spark, "r2", date(2026, 1, 25), 1), "r2")
    assert state.reported().count() == 3 and state.total_reported() == 3
    assert state.window(date(2026, 1, 31), 30) == (date(2026, 1, 25), date(2026, 1, 31))
    assert state.window(date(2026, 1, 31), 30, seed=True) == (date(2026, 1, 1), date(2026, 1, 31))
    assert state.window(date(2026, 3, 31), 30) == (date(2026, 3, 1), date(2026, 3, 31))
    assert dict(rows(merge.run_meta(state.run_log()), "key", "value")) == {"last_run": "2026-01-25", "total_reported": "3"}
    assert rows(merge.running_total(state.run_log()), "run_id", "running_total") == [("r1", 2), ("r2", 3)]
    assert [r.anchor for r in state.state_view().collect()] == ["1. §", "2. §", "3. §"]


def test_state_reset_and_upsert(spark, tmp_path):
    state = MonitorState(spark, str(tmp_path / "s")).create()
    progress = lambda n, ts: spark.createDataFrame(
        [("hr", "2026/1", date(2026, 1, 1), 5, n, ts)], schemas.ISSUE_PROGRESS)
    for run, n in (("r1", 0), ("r2", 4)):
        state.mark_processed(progress(n, datetime(2026, 1, n + 1)), run)
        state.commit(run_row(spark, run, date(2026, 1, 1), 0), run)
    assert rows(state.progress(), "issue_id", "items_relevant") == [("2026/1", 4)]
    state.create()
    assert state.run_log().count() == 2
    mode = "spark.sql.sources.partitionOverwriteMode"
    spark.conf.set(mode, "dynamic")
    try:
        state.reset()
    finally:
        spark.conf.unset(mode)
    assert state.progress().count() == state.reported().count() == state.run_log().count() == 0
    assert rows(merge.run_meta(state.run_log()), "key") == []


def test_state_schemas(spark, tmp_path):
    state = MonitorState(spark, str(tmp_path / "s")).create()
    names = {f.name: f.dataType for f in state.reported().schema.fields}
    assert all(names[f.name] == f.dataType for f in schemas.REPORTED_ITEMS.fields)
    names = {f.name: f.dataType for f in state.progress().schema.fields}
    assert all(names[f.name] == f.dataType for f in schemas.ISSUE_PROGRESS.fields)


def test_content_hash_key(spark, tmp_path):
    state = MonitorState(spark, str(tmp_path / "s")).create()
    keys = tuple(MonitorConfig(dedup_key="content_hash").key_columns)
    assert state.mark_reported(reported(spark, ("1. §", "h1"), ("1. §", "h2"), ("2. §", "h2")), "r1", NOW, keys) == 2


def test_unparseable_run_date_is_no_run(spark):
    log = spark.createDataFrame([("never",), (None,)], "run_date string")
    assert merge.last_run_date(log).first().last_run is None
    later = log.unionByName(spark.createDataFrame([("2026-01-02",)], "run_date string"))
    assert merge.last_run_date(later).first().last_run == date(2026, 1, 2)


# -- report -----------------------------------------------------------------------------------

def one_run(spark, new_items):
    return run_row(spark, "r", date(2026, 7, 2), 0).withColumn("new_items", F.lit(new_items)).withColumn(
        "threshold", F.lit(0.5))


def report_item(spark, url="https://s/indokolas"):
    return reported(spark, ("12. § (3)", "h")).withColumn("run_id", F.lit("r")).withColumn(
        "justification_url", F.lit(url)).withColumn("issue_number", F.lit("2026. évi 83. szám"))


def text_of(df, name="line"):
    return "\n".join(r[name] for r in report.in_report_order(df).collect())


def links(spark, url="https://s/megtekintes"):
    return spark.createDataFrame([("2026. évi 83. szám", url)], "issue_number string, url string")


def test_report_text(spark):
    text = text_of(report.report_lines(one_run(spark, 1), report_item(spark), links(spark)))
    expected = "\n".join([
        "HR Középvállalati Havi Riport", "HR Középvállalati — Magyar Közlöny Havi Riport — 2026-07-02", "",
        "Futtatás dátuma: 2026-07-02", "Lookback: 2026-07-02 -> 2026-07-02", "Feldolgozott lapszámok: 1",
        "Új változások: 1", "=" * 72, "", "Magyar Közlöny 2026. évi 83. szám (2026-01-01)",
        "Ezen a linken éred el ezt a közlönyt: https://s/megtekintes", "-" * 72, "", "§ 12. § (3) — s",
        "  Relevancia: 0.80", "  Témák: bér, őrség", "", "  e", "", "  Határidők: d1, d2", "", "  Teendők:",
        "    - a1", "", "  Indokolás: https://s/indokolas", "", "=" * 72,
        "Automatikusan generálva · Forrás: https://magyarkozlony.hu · Szűrési küszöb: relevancia >= 0.50 (tág) · "
        "Témakör: HR középvállalati (~200 fő)", "", "Generálva: 2026-07-02T00:00:00+00:00"])
    assert text == expected


def test_report_without_links_or_items(spark):
    text = text_of(report.report_lines(one_run(spark, 1), report_item(spark, None), links(spark).limit(0)))
    assert "Ezen a linken" not in text and "Indokolás" not in text and "§ 12. § (3)" in text
    empty = text_of(report.report_lines(one_run(spark, 0), report_item(spark).limit(0), links(spark)))
    assert "nem találtam új" in empty and "Új változások: 0" in empty
    assert "A figyelt időablak: 2026-07-02 - 2026-07-02." in empty


def test_html_report_is_escaped(spark):
    bad = report_item(spark).withColumn("one_line_summary", F.lit("<b>&\"'"))
    html = text_of(report.html_fragments(one_run(spark, 1), bad, links(spark)), "fragment")
    assert html.lower().startswith("<!doctype html>") and html.endswith("</html>")
    assert "&lt;b&gt;&amp;&#34;&#39;" in html and '<span class="topic">őrség</span>' in html
    assert '<a href="https://s/megtekintes">' in html and "Határidők: d1 · d2" in html


def test_outbox(spark):
    cfg = MonitorConfig(email_to="a@x.hu,b@y.hu")
    message = report.outbox(one_run(spark, 3), cfg).first()
    assert message.subject == "[HR riport] 2026-07-02 – 3 új változás"
    assert message.recipients == ["a@x.hu", "b@y.hu"]
    assert "report-2026-07-02.txt" in message.cover and ".html" in message.cover and "kattintható" in message.cover
    plain = report.outbox(one_run(spark, 3), MonitorConfig(html_attachment=False)).first().cover
    assert ".html" not in plain and "sima szöveg" not in plain
    assert message.attachments == ["report-2026-07-02.txt", "report-2026-07-02.html"]
    inline = report.outbox(one_run(spark, 3), MonitorConfig(attachment=False)).first()
    assert inline.cover is None and inline.attachments == []
    assert report.outbox(one_run(spark, 0)).count() == 0


# -- landed files ---------------------------------------------------------------------------------

def test_raw_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>ő</p>".encode("iso-8859-2"))
    (tmp_path / "skip.txt").write_bytes(b"x")
    files = landed.raw_files(spark, str(tmp_path), "*.html").withColumn("charset", F.lit("ISO-8859-2"))
    assert [r.html for r in landed.decoded(files).collect()] == ["<p>ő</p>"]


def test_landed_readers(spark, tmp_path):
    spark.createDataFrame([("i", "<p>x</p>")], schemas.ISSUE_BODIES).coalesce(1).write.parquet(str(tmp_path / "b"))
    table = landed.issue_bodies(spark, str(tmp_path / "b"))
    assert rows(table, "issue_id", "html") == [("i", "<p>x</p>")]


def test_stage_uses_the_clusters_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    stage = Stage(spark)
    assert stage.root.startswith(folder)
    assert hashlib.md5 and stage(spark.range(3), "t").count() == 3


def test_calls_in_flight(spark):
    """Five calls at a time on one task, answers in order, every text asked once."""
    import threading
    import time
    from lawtide.operators.scoring import in_order
    asked, busy, most, lock = [], [0], [0], threading.Lock()

    def make_scorer():
        def scorer(texts):
            with lock:
                asked.extend(texts)
                busy[0] += 1
                most[0] = max(most[0], busy[0])
            time.sleep(0.1)
            with lock:
                busy[0] -= 1
            return [t.upper() for t in texts]
        return scorer

    lists = [[f"t{i}"] for i in range(20)]
    started = time.monotonic()
    got = list(in_order(iter(lists), make_scorer, 5))
    spent = time.monotonic() - started
    assert got == [(x, [x[0].upper()]) for x in lists]
    assert sorted(asked) == sorted(x[0] for x in lists) and most[0] == 5
    assert 0.4 <= spent < 0.2 * 2.0 + 0.3
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "request_id long, request string")
    out = scoring.call_model(rows, lambda: lambda texts: [t.upper() for t in texts], 1, 7, in_flight=3).collect()
    assert sorted((r.request_id, r.reply) for r in out) == [(i, f"T{i}") for i in range(50)]


def test_overloaded_calls_wait(monkeypatch):
    import time
    from lawtide.operators.scoring import Overloaded, in_order
    monkeypatch.setattr(scoring, "FIRST_WAIT", 0.02)
    tries = []

    def scorer(texts):
        tries.append(texts)
        if len(tries) < 3:
            raise Overloaded(wait=0.05 if len(tries) == 1 else None)
        return ["ok" for _ in texts]

    started = time.monotonic()
    assert list(in_order([["a", "b"]], lambda: scorer, 1)) == [(["a", "b"], ["ok", "ok"])]
    assert tries == [["a", "b"]] * 3 and time.monotonic() - started >= 0.08

    def never(texts):
        raise Overloaded()
    ((_, answers),) = in_order([["a"]], lambda: never, 2)
    assert isinstance(answers[0], Overloaded)


def test_latest_landing(spark):
    from lawtide.sources.landed import latest_landing
    at = lambda d: datetime(2026, 7, d)
    rows = [("1", "<p>zzz first landing, withdrawn</p>", at(1)), ("1", "<p>corrected second landing</p>", at(2)), ("1", None, at(3)),
            ("2", "<p>a</p>", None), ("2", "<p>b</p>", None), ("3", "<p>old</p>", None), ("3", "<p>a new</p>", at(1)), ("4", None, at(1))]
    bodies = spark.createDataFrame(rows, "issue_id string, html string, landed_at timestamp").repartition(3)
    got = {r.issue_id: r.html for r in latest_landing(bodies).collect()}
    assert got == {"1": "<p>corrected second landing</p>", "2": "<p>b</p>", "3": "<p>a new</p>"}
    assert {r.issue_id: r.html for r in latest_landing(bodies, at(1)).collect()}["1"] == "<p>zzz first landing, withdrawn</p>"
    issues = spark.createDataFrame([("1", True, "u")], "issue_id string, has_justification boolean, justification_url string")
    (note,) = paragraphs.justification_notes(issues, bodies).collect()
    assert note.justification_text == "corrected second landing"
