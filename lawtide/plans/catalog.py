"""The checked queries: each operator run over whole tables.

A query gets `Tables`; :mod:`lawtide.plans.twins` holds the same answer in SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawtide.config import MonitorConfig
from lawtide.functions import replies, requests, text, urls
from lawtide.functions.binding import computed_once
from lawtide.functions.anchors import inferred_anchor, paragraph_anchor
from lawtide.functions.dates import local_date
from lawtide.functions.lexicon import Scope, keyword_hit, searched_text
from lawtide.operators import counts, dedupe, paragraphs, scoring
from lawtide.operators.lexicon_table import lexicon_rows, match_lexicon
from lawtide.operators.ordered import first_per
from lawtide.operators.prefilter import keyword_filter, match_scopes, tag_topics, with_tags
from lawtide.plans import report
from lawtide.plans.derived import Tables
from lawtide.plans.run import Landed, run, run_scopes
from lawtide.sources import landed, listing
from lawtide.sources.workspace import Stage
from lawtide.state import MonitorState, merge
from lawtide.streaming.arrivals import monitor_arrivals
from lawtide.streaming.recent import unique_in_batch, unique_in_stream

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}

BASE_URL = "https://gazette.example.net"

# The tables are prose in four languages; this lexicon has stems of each.
TABLE_SCOPE = Scope("tables", {
    "t_de": ("heit", "keit", "schaft", "und"),
    "t_en": ("tion", "hand", "the"),
    "t_es": ("ción", "que", "los"),
    "t_fr": ("eau", "eux", "pour"),
}, generic=("ing",))
STRICT_SCOPE = Scope("strict", {"t_th": ("thth", "thing"), "t_eau": ("eaueau", "eauai")}, threshold=0.8)
LATIN_SCOPE = Scope("latin", {"t_c": ("ch", "ç"), "t_n": ("ñ", "aña")})

LEXICON = "scope string, topic string, pattern string"

MAIL = MonitorConfig(email_to="hr@example.org, payroll@example.org", product_name="lawtide")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def as_text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def joined(column: str, separator: str = "|") -> Column:
    return F.array_join(column, separator)


# -- sources -------------------------------------------------------------------

@query
def a1_reachable_pages(t: Tables) -> DataFrame:
    # The fourth page from the end failed to load.
    last = t.pages.agg(F.max("page_id")).first()[0]
    pages = t.pages.select(
        (F.col("page_id") + 1).alias("page_no"), "url",
        F.when(F.col("page_id") != last - 3, F.col("html")).alias("html"))
    kept = listing.reachable_pages(pages, None, document_link='href="/')
    return kept.select("page_no", "url", F.length("html").cast("long").alias("n_chars"))


@query
def a2_issue_bodies(t: Tables) -> DataFrame:
    bodies = t.pages.select(F.col("page_id").alias("doc_id"), "html")
    return bodies.join(t.v_issue, "doc_id").select(
        "issue_id", "issue_number", F.md5("html").alias("body"))


def page_table(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("issue_id"), F.col("turn").alias("page_no"),
        F.col("text").alias("page_text"))


@query
def a3_page_texts(t: Tables) -> DataFrame:
    return paragraphs.page_offsets(page_table(t))


@query
def a3_page_chunks(t: Tables) -> DataFrame:
    return paragraphs.page_chunks(page_table(t), separator="\n").select(
        "issue_id", "pos", "anchor", "text")


@query
def a4_decoded(t: Tables) -> DataFrame:
    latin = F.col("page_id") % 2 == 0
    raw = t.pages.select(
        "page_id", F.when(latin, text.encode_single_byte(F.col("html"), "iso-8859-2")).otherwise(
            F.encode("html", "UTF-8")).alias("content"),
        F.when(latin, F.lit("ISO-8859-2")).otherwise(F.lit("utf-8")).alias("charset"))
    return landed.decoded(raw)


def spa_bodies(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit(
        "<html><body><div id='app'></div></body></html>")).otherwise(F.col("html")).alias("html"))


@query
def a5_source_fallback(t: Tables) -> DataFrame:
    chunks = paragraphs.text_chunks(
        t.documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("page_text")),
        "page_id", separator="\n")
    html = paragraphs.html_paragraphs(spa_bodies(t), "page_id")
    return paragraphs.with_fallback(html, chunks, "page_id").select(
        "page_id", "pos", "anchor", "text")


# -- extraction ------------------------------------------------------------------

@query
def b1_links(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.posexplode(urls.links(F.col("html"), "/[^\"']*")).alias("pos", "link"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), urls.link_href(F.col("link")).alias("href"))


@query
def b2_urls(t: Tables) -> DataFrame:
    return t.v_entry.select("doc_id", urls.absolute_url(F.col("href"), BASE_URL).alias("view_url"))


@query
def b3_derived_urls(t: Tables) -> DataFrame:
    view = F.col("view_url")
    return t.v_issue.select(
        "doc_id", urls.download_url(view).alias("pdf_url"),
        urls.justification_url(view, F.col("has_justification")).alias("justification_url"))


def entry_links(t: Tables) -> DataFrame:
    return listing.page_links(t.v_listing)


@query
def b4_issue_ids(t: Tables) -> DataFrame:
    return t.v_entry.select("doc_id", listing.issue_id(F.col("label")).alias("issue_id")).where(
        "issue_id IS NOT NULL")


@query
def b5_labels(t: Tables) -> DataFrame:
    return entry_links(t).select("page_no", F.col("label").alias("issue_number"))


@query
def b6_dates(t: Tables) -> DataFrame:
    issues = listing.link_issues(entry_links(t), BASE_URL).where("issue_date IS NOT NULL")
    return issues.select("page_no", "issue_id", as_text("issue_date").alias("issue_date"))


@query
def b7_local_dates(t: Tables) -> DataFrame:
    return t.v_entry.select(
        "doc_id", as_text(local_date(F.concat(F.lit("Kelt: "), F.col("date_text")))).alias("issue_date"))


@query
def b8_justified(t: Tables) -> DataFrame:
    return listing.link_issues(entry_links(t), BASE_URL).select(
        "page_no", "issue_id", "has_justification", "justification_url")


def bodies_of(t: Tables) -> DataFrame:
    """The web pages, and under negative numbers bodies of many sections derived from the documents."""
    derived = t.v_body.select((-1 - F.col("doc_id")).alias("page_id"), "html")
    return t.pages.select("page_id", "html").unionByName(derived)


@query
def b9_sections(t: Tables) -> DataFrame:
    found = bodies_of(t).select("page_id", F.explode(paragraphs.sections(F.col("html"))).alias("s"))
    return found.select("page_id", "s.section", "s.heading", "s.text")


@query
def b10_paragraphs(t: Tables) -> DataFrame:
    return paragraphs.html_paragraphs(bodies_of(t), "page_id").select("page_id", "pos", "anchor")


ANCHOR_SAMPLE = (
    "concat(CASE CAST(length(text) % 7 AS int) WHEN 0 THEN 'A ' WHEN 1 THEN 'IV. fejezet (2) ' "
    "WHEN 2 THEN 'xIV. fejezet ' WHEN 3 THEN concat('(', CAST(pos AS string), ') XII. cím ') "
    "WHEN 4 THEN concat(CAST(length(text) AS string), '. § ') WHEN 5 THEN 'II. fejezetek ' "
    "ELSE concat('V.  rész ', CAST(pos AS string), '.§') END, text)"
)


@query
def b11_anchors(t: Tables) -> DataFrame:
    heading = t.v_par.withColumn("heading", F.expr(ANCHOR_SAMPLE))
    return heading.select(
        "doc_id", "pos", inferred_anchor(F.col("heading")).alias("anchor"),
        paragraph_anchor(F.col("text")).alias("paragraph_anchor"))


@query
def b12_chunks(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", F.col("text").alias("page_text"))
    return paragraphs.text_chunks(texts, "doc_id", separator="\n").select(
        "doc_id", "pos", "anchor", "text")


@query
def b13_html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


def parsed(t: Tables) -> DataFrame:
    return computed_once(t.v_reply, parsed=replies.reply_object(F.col("reply")))


@query
def b14_json_payload(t: Tables) -> DataFrame:
    body = replies.unfenced(F.col("reply"))
    return t.v_reply.select("doc_id", body.alias("body"), replies.brace_span(body).alias("span"))


@query
def b15_strict_json(t: Tables) -> DataFrame:
    return parsed(t).select(
        "doc_id", F.col("parsed").isNotNull().alias("parsed"),
        replies.is_object(replies.single_value(F.col("reply"))).alias("whole"))


# -- scalar expressions ------------------------------------------------------------

@query
def c1_content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query
def c2_keyword_match(t: Tables) -> DataFrame:
    return t.v_par.select(
        "doc_id", "pos", keyword_hit(searched_text(F.col("text")), TABLE_SCOPE).alias("hit"))


@query
def c3_topics(t: Tables) -> DataFrame:
    tagged = tag_topics(t.v_par, TABLE_SCOPE)
    return tagged.select("doc_id", "pos", joined("topics").alias("topics"))


@query
def c4_searched_text(t: Tables) -> DataFrame:
    context = F.when(F.col("lang") == "en", F.col("source"))
    return t.documents.select("doc_id", F.md5(searched_text(F.col("text"), context)).alias("searched"))


def coerced(t: Tables) -> DataFrame:
    fields = replies.score_fields(F.col("parsed"))
    return parsed(t).select(
        "doc_id", F.when(F.col("parsed").isNull(), F.lit(scoring.STILL_BROKEN)).alias("error"),
        *[c.alias(n) for n, c in fields.items()])


@query
def c5_score_defaults(t: Tables) -> DataFrame:
    return coerced(t).where("error IS NULL").select(
        "doc_id", "is_relevant", "score", joined("matched_topics").alias("matched_topics"),
        "one_line_summary", "reasoning")


@query
def c6_enrich_defaults(t: Tables) -> DataFrame:
    fields = replies.enrich_fields(F.col("parsed"), F.col("one_line_summary"))
    read = computed_once(t.v_enriched, parsed=replies.reply_object(F.col("reply")))
    return read.select("doc_id", *[c.alias(n) for n, c in fields.items()]).select(
        "doc_id", "expansion", joined("key_dates").alias("key_dates"),
        joined("action_items").alias("action_items"))


@query
def c7_score_request(t: Tables) -> DataFrame:
    context = F.when(F.col("lang") == "fr", F.concat(F.lit("  "), F.col("source"), F.lit("\n"))).otherwise(F.lit("  "))
    return t.documents.select("doc_id", requests.score_request(F.col("text"), context).alias("request"))


@query
def c8_enrich_request(t: Tables) -> DataFrame:
    context = F.when(F.col("pos") % 2 == 0, F.col("expansion")).otherwise(F.lit(""))
    return t.v_scored.select("doc_id", "pos", requests.enrich_request(
        *[F.col(n) for n in ("anchor", "score", "matched_topics", "one_line_summary", "text")],
        context, F.col("justification_url")).alias("request"))


@query
def c9_dedup_key(t: Tables) -> DataFrame:
    return t.v_key.select(
        "doc_id", "pos", dedupe.dedup_key(F.col("issue_number"), F.col("anchor")).alias("dedup_key"))


@query
def c10_json_lists(t: Tables) -> DataFrame:
    written = t.v_scored.withColumn("action_items_json", text.list_to_json(F.col("action_items")))
    return written.select(
        "doc_id", "pos", text.list_to_json(F.col("matched_topics")).alias("matched_topics"),
        "action_items_json",
        F.array_join(text.json_to_list(F.col("action_items_json")), "|").alias("read_back"))


@query
def c12_contract_checks(t: Tables) -> DataFrame:
    checks = replies.score_checks(*[F.col(n) for n in (
        "is_relevant", "score", "matched_topics", "one_line_summary")])
    checks |= replies.enrich_checks(F.col("expansion"), F.col("action_items"))
    marked = t.v_scored.select("issue_id", *[c.alias(n) for n, c in checks.items()])
    return marked.groupBy("issue_id").agg(*[F.count_if(n).alias(n) for n in checks])


@query
def c13_display(t: Tables) -> DataFrame:
    return t.v_scored.select(
        "doc_id", "pos", text.score_text(F.col("score")).alias("score"),
        text.topics_text(F.col("matched_topics")).alias("topics"),
        text.label_text(F.col("issue_number")).alias("label"),
        text.short_summary(F.col("one_line_summary")).alias("summary"),
        text.escape_html(F.concat(F.lit("<'\"&"), F.col("one_line_summary"))).alias("escaped"))


# -- filters -----------------------------------------------------------------------

@query
def d1_no_bulletin(t: Tables) -> DataFrame:
    return listing.link_issues(entry_links(t), BASE_URL).select("page_no", "issue_number")


@query
def d2_window(t: Tables) -> DataFrame:
    rows = listing.in_window(t.orders, date(1997, 3, 1), date(1998, 2, 28), "o_orderdate")
    return rows.select("o_orderkey", as_text(F.to_date("o_orderdate")).alias("order_date"))


@query
def d3_long_enough(t: Tables) -> DataFrame:
    return paragraphs.long_enough(t.v_par, 30).select("doc_id", "pos")


@query
def d4_keyword_filter(t: Tables) -> DataFrame:
    return keyword_filter(t.v_par, TABLE_SCOPE).select("doc_id", "pos")


@query
def d5_relevant(t: Tables) -> DataFrame:
    return scoring.relevant(t.v_scored, 0.50).select("doc_id", "pos", "score")


@query
def d6_failed(t: Tables) -> DataFrame:
    return scoring.failed(t.v_scored).select("doc_id", "pos", "error")


# -- joins ---------------------------------------------------------------------------

@query
def e1_unprocessed(t: Tables) -> DataFrame:
    return dedupe.unprocessed(t.v_issue, t.v_progress).select("issue_id")


@query
def e2_unreported(t: Tables) -> DataFrame:
    rows = dedupe.unreported(t.v_scored, t.v_reported)
    return dedupe.with_content_hash(rows).select("issue_id", "anchor", "pos", "content_hash")


@query
def e3_issue_attributes(t: Tables) -> DataFrame:
    known = t.v_issue.where("lang <> 'fr'")
    return dedupe.with_issue(t.v_key.select("issue_id", "pos"), known).select(
        "issue_id", "pos", "issue_number", as_text("issue_date").alias("issue_date"))


@query
def e4_justification(t: Tables) -> DataFrame:
    by_doc = {"issue_id": F.col("doc_id")}
    issues = t.v_issue.withColumns(by_doc).withColumn("justification_url", F.lit("u"))
    first, second = F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 2))
    notes = t.pages.select(F.col("page_id").alias("issue_id"), "html", second.alias("landed_at"))
    withdrawn = notes.withColumns({"html": F.lit("<p>zzz withdrawn</p>"), "landed_at": first})
    notes = notes.unionByName(withdrawn).unionByName(notes)
    rows = paragraphs.with_justification(t.v_par.withColumnRenamed("doc_id", "issue_id"), issues, notes)
    return rows.select(
        "issue_id", "pos", "has_justification", "justification_url", "justification_text")


@query
def e5_replies_by_id(t: Tables) -> DataFrame:
    asked = t.v_key.withColumn("request_id", scoring.request_id(
        F.col("issue_id"), F.col("anchor"), F.col("pos"), F.col("text")))
    answered = t.v_reply.join(asked.select("doc_id", "request_id"), "doc_id").select("request_id", "reply")
    return scoring.attach_replies(asked, answered.unionByName(answered)).select(
        "doc_id", "pos", "request_id", "reply")


@query
def e6_issue_links(t: Tables) -> DataFrame:
    labelled = t.v_issue.withColumn("issue_number", F.concat(F.lit("szám "), F.floor(F.col("doc_id") / 3)))
    return dedupe.link_per_label(labelled)


# -- aggregations ----------------------------------------------------------------------

@query
def f1_classified(t: Tables) -> DataFrame:
    return counts.per_issue(paragraphs.long_enough(t.v_key), "items_classified")


@query
def f2_relevant(t: Tables) -> DataFrame:
    return counts.per_issue(t.v_items, "items_relevant")


def flagged(t: Tables) -> DataFrame:
    """Every paragraph with the stages it passed. State is looked up before scoring."""
    known = t.v_reported.withColumn("reported", F.lit(True))
    rows = t.v_key.join(known, ["issue_number", "anchor"], "left")
    found, tags = with_tags(rows, [TABLE_SCOPE])
    topics = tags[TABLE_SCOPE.name]
    staged = found.withColumn("kept", F.length("text") >= 30).withColumn("topics", topics)
    scored = staged.withColumn("candidate", F.col("kept") & F.col("topics").isNotNull()).withColumn(
        "score", scoring.lexical_score(F.col("topics")))
    relevant = F.col("candidate") & (F.col("score") >= 0.5)
    return scored.withColumn("relevant", relevant).withColumn(
        "dropped", relevant & F.col("reported").isNotNull()).withColumn(
        "new", relevant & F.col("reported").isNull())


@query
def f3_funnel(t: Tables) -> DataFrame:
    return counts.funnel(flagged(t), "kept", "candidate", "relevant", "dropped", "new")


@query
def f4_grouped_items(t: Tables) -> DataFrame:
    return counts.grouped_items(t.v_items).select(
        "issue_number", as_text("issue_date").alias("issue_date"), "anchor", "pos",
        F.col("item_rank").cast("long").alias("item_rank"), text.score_text(F.col("score")).alias("score"))


@query
def f5_running_total(t: Tables) -> DataFrame:
    totals = merge.running_total(t.v_runs.select("run_id", "run_ts", "persisted"), "minute")
    return totals.select("run_id", F.col("running_total").cast("long").alias("running_total"))


@query
def f6_last_run(t: Tables) -> DataFrame:
    log = t.v_runs.select(F.col("run_date_text").alias("run_date"))
    return merge.last_run_date(log).select(as_text("last_run").alias("last_run"))


@query
def f7_issues_with_items(t: Tables) -> DataFrame:
    return counts.issues_with_items(t.v_items)


# -- first and last per key ------------------------------------------------------------

@query
def g1_first_per_page(t: Tables) -> DataFrame:
    issues = listing.link_issues(entry_links(t), BASE_URL)
    return first_per(issues, ["page_no", "issue_id"], ["pos"]).select("page_no", "issue_id", "view_url")


@query
def g2_last_page_wins(t: Tables) -> DataFrame:
    return listing.listed_issues(t.v_listing, BASE_URL).select(
        "issue_id", "page_no", "issue_number", as_text("issue_date").alias("issue_date"),
        "has_justification", "view_url", "pdf_url", "justification_url")


@query
def g3_section_ids(t: Tables) -> DataFrame:
    numbers = F.transform(paragraphs.sections(F.col("html")), lambda s: s["section"])
    return bodies_of(t).select("page_id", F.explode(numbers).alias("section"))


@query
def g4_chunk_ordinals(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", F.col("text").alias("page_text"))
    return paragraphs.text_chunks(texts, "doc_id", min_chars=0, separator="\n").select("doc_id", "pos")


@query
def g5_first_writer(t: Tables) -> DataFrame:
    return dedupe.first_writer(t.v_items).select("issue_number", "anchor", "pos")


# -- order and top-k -----------------------------------------------------------------------

@query
def h1_newest_first(t: Tables) -> DataFrame:
    return listing.newest(t.v_issue).select("issue_id", as_text("issue_date").alias("issue_date"))


@query
def h2_cap(t: Tables) -> DataFrame:
    orders = t.orders.select(
        F.col("o_orderkey").cast("string").alias("issue_id"),
        F.to_date("o_orderdate").alias("issue_date"))
    capped = listing.newest(orders, 50)
    processed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("issue_id"))
    return dedupe.unprocessed(capped, processed).select("issue_id", as_text("issue_date").alias("issue_date"))


def runs_with_items(t: Tables) -> DataFrame:
    """One run over all items, its figures counted from them."""
    figures = t.v_items.agg(
        F.countDistinct("issue_id").alias("issues_scanned"), F.count(F.lit(1)).alias("new_items"))
    return figures.select(
        F.lit("run").alias("run_id"), F.lit(date(2024, 7, 2)).alias("run_date"),
        F.lit(date(2024, 6, 2)).alias("window_start"), F.lit(date(2024, 7, 2)).alias("window_end"),
        "issues_scanned", "new_items", F.lit(0.5).alias("threshold"),
        F.timestamp_seconds(F.lit(1719907200)).alias("run_ts"))


@query
def h3_report_order(t: Tables) -> DataFrame:
    order = [F.desc("issue_date"), F.desc("issue_number"), "anchor", "pos"]
    return t.v_items.orderBy(*order).select(
        as_text("issue_date").alias("issue_date"), "issue_number", "anchor", "pos")


@query
def h4_reported_in_window(t: Tables) -> DataFrame:
    rows = merge.reported_in_window(dedupe.first_writer(t.v_items), date(2024, 2, 1), date(2024, 5, 31))
    return rows.select(as_text("issue_date").alias("issue_date"), "issue_number", "anchor", "score")


@query
def h5_state_view(t: Tables) -> DataFrame:
    from lawtide.state.tables import ANY_DATE, state_rows
    everything = merge.reported_in_window(dedupe.first_writer(t.v_items), *ANY_DATE)
    rows = state_rows(everything.limit(50))
    totals = merge.total_reported(t.v_runs)
    return rows.withColumn("issue_date", as_text("issue_date")).withColumn(
        "total_reported", totals.scalar().cast("long"))


# -- set operations and state ---------------------------------------------------------------

@query
def i1_progress_rows(t: Tables) -> DataFrame:
    rows = counts.progress_rows(
        t.v_issue, paragraphs.long_enough(t.v_key), t.v_items, F.timestamp_seconds(F.lit(1719907200)))
    return rows.select("issue_id", as_text("issue_date").alias("issue_date"), "items_classified", "items_relevant")


@query
def j1_insert_if_absent(t: Tables) -> DataFrame:
    new = merge.insert_if_absent(
        t.v_items, t.v_reported, ["issue_number", "anchor"], ["issue_id", "pos"])
    return new.select("issue_number", "anchor", "pos")


@query
def j2_upsert(t: Tables) -> DataFrame:
    old = t.v_progress.select(
        "issue_id", F.lit(0).cast("long").alias("items_relevant"), F.lit(1).alias("version"))
    new = counts.per_issue(t.v_items, "items_relevant").withColumn("version", F.lit(2))
    return merge.upsert(old, new, ["issue_id"], "version").select("issue_id", "items_relevant")


@query
def j3_run_meta(t: Tables) -> DataFrame:
    written = t.v_runs.select(
        F.concat(F.lit("key "), F.col("new_items")).alias("key"),
        as_text("persisted").alias("value"), F.struct("run_ts", "run_id").alias("written"))
    last = merge.latest(written, ["key"], "written").select("key", "value")
    return last.unionByName(merge.run_meta(t.v_runs))


@query
def j5_window(t: Tables) -> DataFrame:
    ends = t.orders.agg(
        F.max("o_orderdate").cast("date").alias("run"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).cast("date").alias("last")).first()
    # Two values; as literals they reach the scan.
    start, end = merge.run_window(ends.run, ends.last - timedelta(days=20), 30)
    rows = listing.in_window(t.orders, start, end, "o_orderdate")
    return rows.select("o_orderkey", as_text(F.to_date("o_orderdate")).alias("order_date"))


# -- scoring -----------------------------------------------------------------------------------

def candidates(t: Tables) -> DataFrame:
    return keyword_filter(paragraphs.long_enough(t.v_key), TABLE_SCOPE).withColumn(
        "justification_text", F.lit(""))


@query
def k1_lexical_scores(t: Tables) -> DataFrame:
    return scoring.lexical_scores(candidates(t), TABLE_SCOPE).select(
        "issue_id", "pos", "is_relevant", "score", joined("matched_topics").alias("matched_topics"),
        "one_line_summary")


def length_scorer() -> scoring.Scorer:
    """A stand-in model: judges by the length of the request. Replies to every third
    request are malformed at first; a few calls fail."""
    def reply(request: str) -> object:
        n = len(request)
        if "is none" in request:
            return "still { broken" if n % 2 else '{"is_relevant": true, "score": 0.55}'
        if n % 11 == 0:
            return RuntimeError("overloaded")
        if n % 3 == 0:
            return '{"is_relevant": true, "one_line_summary_hu": "a "b""' + "!" * (n % 8) + "}"
        return json.dumps({"is_relevant": n % 2 == 0, "score": n % 100 / 100, "matched_topics": [f"n{n % 4}"]})
    return lambda texts: [reply(x) for x in texts]


def model_scores(t: Tables) -> DataFrame:
    return scoring.score(candidates(t), length_scorer, 8, Stage(t.spark))


@query
def k1_model_scores(t: Tables) -> DataFrame:
    return model_scores(t).select(
        "issue_id", "pos", "is_relevant", "score", joined("matched_topics").alias("matched_topics"), "error")


@query
def k2_repaired(t: Tables) -> DataFrame:
    asked = model_scores(t).withColumn("request", requests.score_request(F.col("text"), F.col("justification_text")))
    malformed = (F.length("request") % 3 == 0) & (F.length("request") % 11 != 0)
    return asked.where(malformed).select("issue_id", "pos", "is_relevant", "score", "error")


@query
def k3_errors(t: Tables) -> DataFrame:
    return scoring.failed(model_scores(t)).groupBy("error", "is_relevant", "score").agg(
        F.count(F.lit(1)).alias("n"))


def echo_enricher() -> scoring.Scorer:
    return lambda texts: [json.dumps(
        {"expansion_hu": f"{len(x)} karakter", "key_dates_hu": [], "action_items_hu": ["HR: olvasni"]}) for x in texts]


@query
def k4_enriched(t: Tables) -> DataFrame:
    items = t.v_items.drop("expansion", "key_dates", "action_items").withColumn("justification_text", F.lit(""))
    return scoring.enrich(items, echo_enricher, 8, Stage(t.spark)).select(
        "issue_id", "pos", "expansion", joined("action_items").alias("action_items"))


@query
def k4_lexical_enrichment(t: Tables) -> DataFrame:
    dated = t.v_items.drop("expansion", "key_dates", "action_items").withColumn("text", F.concat(
        F.lit("Hatály: 2024. MÁJUS 5. és 2024. június "), F.col("pos"), F.lit(". "), F.col("text")))
    return scoring.lexical_enrichment(dated).select(
        "issue_id", "pos", "expansion", joined("key_dates").alias("key_dates"))


@query
def k6_scopes(t: Tables) -> DataFrame:
    scopes = [TABLE_SCOPE, STRICT_SCOPE, LATIN_SCOPE]
    lexicon = t.spark.createDataFrame(lexicon_rows(scopes), LEXICON)
    thresholds = t.spark.createDataFrame([(s.name, s.threshold) for s in scopes], "scope string, threshold double")
    matched = match_lexicon(t.v_par, lexicon, Stage(t.spark), thresholds=thresholds)
    scored = matched.withColumn("score", scoring.lexical_score(F.col("topics")))
    return scored.where("score >= threshold").select(
        "doc_id", "pos", "scope", joined("topics").alias("topics"), "score")


@query
def k6_lexicon_table(t: Tables) -> DataFrame:
    """Fifty scopes whose stems are the words of the benchmark, and the scopes that paragraphs hit."""
    words = t.benchmark.select("item_id", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"[a-z]{4,}"), F.lit(0))).alias("word"))
    lexicon = words.select(
        F.concat(F.lit("s"), F.crc32("word") % 50).alias("scope"),
        F.when(F.crc32("word") % 3 > 0, F.substring("word", 1, 2)).alias("topic"), F.col("word").alias("pattern"))
    matched = match_lexicon(t.v_par, lexicon.distinct(), Stage(t.spark))
    return matched.select("doc_id", "pos", "scope", joined("topics").alias("topics"))


# -- reports ---------------------------------------------------------------------------------------

def shown_keys(lines: DataFrame, value: str) -> DataFrame:
    return lines.select(
        F.col("part").cast("long").alias("part"), as_text("issue_date").alias("issue_date"),
        "issue_number", F.col("level").cast("long").alias("level"), "anchor", "pos",
        F.col("line_no").cast("long").alias("line_no"), value)


@query
def l1_report_lines(t: Tables) -> DataFrame:
    links = dedupe.link_per_label(t.v_issue.where("lang <> 'es'"))
    return shown_keys(report.report_lines(runs_with_items(t), t.v_items, links), "line")


@query
def l2_empty_reports(t: Tables) -> DataFrame:
    # Items belong to the run of their document's number. Runs that none belongs to say so if they found nothing.
    items = t.v_items.withColumn("run_id", F.concat(F.lit("r"), F.lpad(as_text("doc_id"), 12, "0")))
    runs = t.v_runs.join(items.select("run_id").distinct(), "run_id", "left_anti").select(
        "run_id", "run_date", F.date_sub("run_date", 30).alias("window_start"),
        F.col("run_date").alias("window_end"), "issues_scanned", "new_items", "threshold", "run_ts")
    lines = report.report_lines(runs, items, t.v_issue.select("issue_number", F.col("view_url").alias("url")))
    return lines.where("part = 0").select(
        "run_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query
def l3_html_fragments(t: Tables) -> DataFrame:
    links = dedupe.link_per_label(t.v_issue.where("lang <> 'es'"))
    return shown_keys(report.html_fragments(runs_with_items(t), t.v_items, links), "fragment")


@query
def l4_outbox(t: Tables) -> DataFrame:
    return report.outbox(t.v_runs, MAIL).select(
        "run_id", "subject", "sender", joined("recipients").alias("recipients"), "cover",
        joined("attachments").alias("attachments"))


@query
def a6_report_files(t: Tables) -> DataFrame:
    stage = Stage(t.spark)
    links = dedupe.link_per_label(t.v_issue)
    runs = runs_with_items(t)
    report.write_report(report.report_lines(runs, t.v_items, links), runs, stage.path("report"))
    written = t.spark.read.text(stage.path("report"))
    return written.select(as_text("run_date").alias("run_date"), F.col("value").alias("line"))


@query
def a7_state_tables(t: Tables) -> DataFrame:
    state = MonitorState(t.spark, Stage(t.spark).path("state")).create()
    now = datetime(2024, 7, 2, 8, 0, 0, 123456)
    for run_id, rows in (("r1", t.v_items.where("score >= 0.75")), ("r2", t.v_items)):
        hashed = dedupe.with_content_hash(rows)
        inserted = state.mark_reported(hashed, run_id, now)
        state.commit(state.log_row(
            run_id=run_id, scope="hr", run_date=now.date(), run_ts=now, persisted=inserted), run_id)
    return state.reported().select(
        "run_id", "dedup_key", "content_hash", "score", joined("key_dates").alias("key_dates"),
        joined("action_items").alias("action_items"), as_text("reported_at").alias("reported_at"),
        F.lit(state.total_reported()).cast("long").alias("total_reported"))


@query
def a7_compacted_state(t: Tables) -> DataFrame:
    """As above, with the parts folded twice: before a run that was folded is run again, and after."""
    state = MonitorState(t.spark, Stage(t.spark).path("state")).create()
    now = datetime(2024, 7, 2, 8, 0, 0, 123456)
    rounds = (("r1", 0.75), ("r2", 0.6), ("fold", None), ("r2", 0.0), ("fold", None))
    for run_id, least in rounds:
        if run_id == "fold":
            state.compact()
            continue
        hashed = dedupe.with_content_hash(t.v_items.where(F.col("score") >= least))
        inserted = state.mark_reported(hashed, run_id, now)
        state.commit(state.log_row(
            run_id=run_id, scope="hr", run_date=now.date(), run_ts=now, persisted=inserted), run_id)
    state.vacuum(timedelta(0))
    return state.reported().select(
        "run_id", "dedup_key", "content_hash", "score", joined("key_dates").alias("key_dates"),
        joined("action_items").alias("action_items"), as_text("reported_at").alias("reported_at"),
        F.lit(state.total_reported()).cast("long").alias("total_reported"))


@query
def j4_reset(t: Tables) -> DataFrame:
    """Rows left after a reset in a session that overwrites partitions dynamically, and rows written before."""
    state = MonitorState(t.spark, Stage(t.spark).path("state")).create()
    now = datetime(2024, 7, 2, 8)
    items = dedupe.with_content_hash(t.v_items.where("score >= 0.75"))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = t.spark.conf.get(mode)
    t.spark.conf.set(mode, "dynamic")
    try:
        state.mark_reported(items, "r1", now)
        state.commit(state.log_row(run_id="r1", scope="hr", run_date=now.date(), run_ts=now, persisted=1), "r1")
        state.reset()
    finally:
        t.spark.conf.set(mode, before)
    left = [rows.agg(F.count("*").alias(name)) for name, rows in (
        ("reported", state.reported()), ("progress", state.progress()), ("runs", state.run_log()))]
    out = items.agg(F.count("*").alias("written"))
    for one in left:
        out = out.withColumn(one.columns[0], F.col("written") * 0 + one.scalar())
    return out


@query
def j5_open_issues(t: Tables) -> DataFrame:
    """Issues two runs left open and a third did not process either; the last reason counts."""
    state = MonitorState(t.spark, Stage(t.spark).path("state")).create()
    numbered = t.documents.select((F.col("doc_id") % 3000 + 1).alias("n")).distinct().select(
        "n", F.concat(F.lit("2024/"), F.col("n")).alias("issue_id"), F.lit("").alias("issue_number"),
        F.lit(date(2024, 1, 1)).alias("issue_date"), F.lit(False).alias("has_justification"),
        *[F.lit(None).cast("string").alias(c) for c in ("view_url", "pdf_url", "justification_url")])
    first = numbered.where("n % 5 IN (0, 1)").withColumn("reason", F.lit("no content"))
    second = numbered.where("n % 5 = 0").withColumn("reason", F.lit("failed"))
    third = numbered.where("n % 3 = 0").select(
        "issue_id", "issue_date", F.lit(1).alias("items_classified"), F.lit(0).alias("items_relevant"),
        F.lit(datetime(2024, 7, 3)).alias("processed_at"))
    for run_id, left_open, day in (("r1", first, 1), ("r2", second, 2)):
        state.mark_open(left_open, run_id, datetime(2024, 7, day))
        state.commit(state.log_row(run_id=run_id, scope="hr", run_date=date(2024, 7, day)), run_id)
    state.mark_processed(third, "r3")
    state.commit(state.log_row(run_id="r3", scope="hr", run_date=date(2024, 7, 3)), "r3")
    # A run that failed before its log row is not seen.
    state.mark_open(numbered.withColumn("reason", F.lit("capped")), "r4", datetime(2024, 7, 4))
    return state.open_issues("hr").select("issue_id", "reason")


def landed_tables(t: Tables) -> Landed:
    """Listing pages of all documents; web pages as bodies, documents as page texts."""
    def issue(n: str) -> Column:
        return F.concat_ws("/", 2010 + F.col(n) % 15, F.col(n))
    bodies = t.pages.select(issue("page_id").alias("issue_id"), "html")
    texts = t.documents.select(
        issue("doc_id").alias("issue_id"), F.lit(1).cast("long").alias("page_no"), F.col("text").alias("page_text"))
    return Landed(t.v_listing.withColumn("url", F.lit("")), bodies, texts, bodies)


@query
def l5_run_row(t: Tables) -> DataFrame:
    """A whole run, from listing pages to state; its log row."""
    stage = Stage(t.spark)
    state = MonitorState(t.spark, stage.path("state")).create()
    cfg = MonitorConfig(lookback_days=365, base_url=BASE_URL)
    result = run(
        t.spark, cfg, state, landed_tables(t), "r1", date(2024, 9, 30), datetime(2024, 9, 30, 8), scope=TABLE_SCOPE,
        report_root=stage.path("reports"), stage=stage)
    kept = F.lit(result.counts["paragraphs"]).cast("long")
    return state.run_log().select(
        "run_id", as_text("window_start").alias("window_start"), "issues_scanned", kept.alias("paragraphs"),
        "candidates", "relevant", "new_items", "persisted", F.size("warnings").cast("long").alias("warnings"))


@query
def a8_dry_run(t: Tables) -> DataFrame:
    """A run that writes nothing: its figures, and what is in the state and under the report folder after it."""
    stage = Stage(t.spark)
    state = MonitorState(t.spark, stage.path("state")).create()
    cfg = MonitorConfig(lookback_days=365, base_url=BASE_URL)
    result = run(
        t.spark, cfg, state, landed_tables(t), "r1", date(2024, 9, 30), datetime(2024, 9, 30, 8), scope=TABLE_SCOPE,
        report_root=stage.path("reports"), write=False, stage=stage)
    rows = [state.reported(), state.progress(), state.open_issues(TABLE_SCOPE.name), state.run_log()]
    return result.run_row.select(
        "issues_scanned", "candidates", "relevant", "new_items", "persisted", "report_path",
        F.lit(sum(r.count() for r in rows)).cast("long").alias("written"))


@query
def k6_run_scopes(t: Tables) -> DataFrame:
    """Two scopes on one state, their texts parsed once; their log rows."""
    stage = Stage(t.spark)
    state = MonitorState(t.spark, stage.path("state")).create()
    run_scopes(
        t.spark, MonitorConfig(lookback_days=365, base_url=BASE_URL), state, landed_tables(t), "r1",
        date(2024, 9, 30), datetime(2024, 9, 30, 8), [TABLE_SCOPE, STRICT_SCOPE], stage=stage)
    return state.run_log().select(
        "run_id", "scope", "issues_scanned", "candidates", "relevant", "new_items", "persisted")


# -- streaming -----------------------------------------------------------------------------------------

def stream_of(t: Tables, table: str) -> DataFrame:
    batch = getattr(t, table)
    source = t.spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{table}.parquet")
    return source.parquet(t.folder)


@query
def m1_arrivals(t: Tables) -> DataFrame:
    stage = Stage(t.spark)
    state = MonitorState(t.spark, stage.path("state")).create()
    year = F.lit("2024. évi ")
    bodies = stream_of(t, "pages").select(
        F.concat(F.lit("2024/"), F.col("page_id")).alias("issue_id"),
        F.concat(year, F.col("page_id"), F.lit(". szám")).alias("issue_number"),
        F.lit(date(2024, 1, 15)).alias("issue_date"), "html")
    monitor_arrivals(bodies, state, stage.path("offsets"), scope=TABLE_SCOPE).awaitTermination()
    return state.reported().select(
        "issue_number", "anchor", "content_hash", "score", joined("matched_topics").alias("matched_topics"))


def wordless_scorer() -> scoring.Scorer:
    """A stand-in model that accepts every text."""
    return lambda texts: ['{"is_relevant": true, "score": 0.9, "one_line_summary_hu": "-"}' for _ in texts]


def failing_scorer() -> scoring.Scorer:
    """The same, but for calls about some texts, which fail."""
    reply = wordless_scorer()
    return lambda texts: [RuntimeError("down") if len(x) % 3 == 0 else reply([x])[0] for x in texts]


@query
def m1_retries(t: Tables) -> DataFrame:
    """Two batches: what the model fails to answer in the first is reported with the second, and lands once."""
    stage = Stage(t.spark)
    state = MonitorState(t.spark, stage.path("state")).create()
    issues = t.pages.select(
        F.concat(F.lit("2024/"), F.col("page_id")).alias("issue_id"),
        F.concat(F.lit("2024. évi "), F.col("page_id"), F.lit(". szám")).alias("issue_number"),
        F.lit(date(2024, 1, 15)).alias("issue_date"), "html", (F.col("page_id") % 2).alias("half"))
    for half, scorer in ((0, failing_scorer), (1, wordless_scorer)):
        issues.where(F.col("half") == half).drop("half").write.mode("append").parquet(stage.path("landed"))
        bodies = t.spark.readStream.schema(issues.drop("half").schema).parquet(stage.path("landed"))
        monitor_arrivals(
            bodies, state, stage.path("offsets"), scope=TABLE_SCOPE, make_scorer=scorer).awaitTermination()
    left_open = state.open_issues(TABLE_SCOPE.name).agg(F.count("*").alias("left_open"))
    return state.reported().select("issue_number", "anchor", "content_hash", "score").withColumn(
        "left_open", F.lit(left_open.first().left_open))


@query
def m2_recent_stream(t: Tables) -> DataFrame:
    stage = Stage(t.spark)
    events = stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    unique = unique_in_stream(events, "ts", ["user_id", "event_type"], "40 days")
    unique.select("user_id", "event_type").writeStream.format("parquet").option(
        "checkpointLocation", stage.path("offsets")).option("path", stage.path("unique")).trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.schema("user_id long, event_type string").parquet(stage.path("unique"))


@query
def m2_recent_batch(t: Tables) -> DataFrame:
    return unique_in_batch(t.events, "ts", ["user_id", "event_type"], ["event_id"]).select(
        "event_id", "user_id", "event_type")


# -- the first slice --------------------------------------------------------------------------------------

@query
def topic_counts(t: Tables) -> DataFrame:
    """Paragraphs and distinct texts per topic and language."""
    hashed = dedupe.with_content_hash(paragraphs.long_enough(t.v_par))
    matched = match_scopes(hashed, [TABLE_SCOPE]).withColumn("topic", F.explode("topics"))
    return matched.groupBy("topic", "lang").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.countDistinct("content_hash").alias("texts"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(spark, folder))
    return {name: bind(fn) for name, fn in QUERIES.items()}
