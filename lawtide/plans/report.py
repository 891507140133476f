"""Report datasets. One row per line or fragment; nothing is gathered per run or issue.

`runs` holds one row per run: run_id, run_date, window_start, window_end,
issues_scanned, new_items, threshold, run_ts. `items` holds report items with run_id
and pos. `links` maps issue_number to url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.config import MonitorConfig
from lawtide.functions.text import escape_html, label_text, score_text, topics_text

# Texts of the report.
TITLE = "HR Középvállalati Havi Riport"
FULL_TITLE = "HR Középvállalati — Magyar Közlöny Havi Riport — "
NOTHING_NEW = (
    "Ebben a futásban nem találtam új, a HR területét (munkajog, bér, "
    "juttatás, foglalkoztatás, munkavédelem) érintő bekezdést a Magyar Közlönyben."
)
LINK_INTRO = "Ezen a linken éred el ezt a közlönyt: "
SOURCE = "Automatikusan generálva · Forrás: https://magyarkozlony.hu · "
SUBJECT_AREA = "Témakör: HR középvállalati (~200 fő)"
DOUBLE_RULE, RULE = "=" * 72, "-" * 72

# Order of a report: header, issues newest first, each with its items by anchor, footer.
HEADER, BODY, FOOTER = 0, 1, 2
LINE_KEYS = ["run_id", "part", "issue_date", "issue_number", "level", "anchor", "pos", "line_no"]
LINE_ORDER = [
    F.asc, F.asc, F.desc, F.desc, F.asc, F.asc, F.asc, F.asc,
]

NO_LINES = "array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _lines_if(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast(NO_LINES))


def _filled(items: str) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def _given(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")) != ""


def _rows(df: DataFrame, part: int, level: int, lines: Column, name: str = "line") -> DataFrame:
    """Number the lines of each row and bring all kinds of rows to one shape."""
    missing = {"issue_date": "date", "issue_number": "string", "anchor": "string", "pos": "long"}
    for column, kind in missing.items():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast(kind))
    return df.select(
        "run_id", F.lit(part).alias("part"), "issue_date", "issue_number", F.lit(level).alias("level"),
        "anchor", F.col("pos").cast("long").alias("pos"), F.posexplode(lines).alias("line_no", name))


def report_issues(items: DataFrame, links: DataFrame) -> DataFrame:
    """One row per run and issue of the report, with the issue's address if known."""
    issues = items.groupBy("run_id", "issue_number", "issue_date").agg(F.count(F.lit(1)).alias("n_items"))
    return issues.join(links.select("issue_number", "url"), "issue_number", "left")


def report_lines(runs: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """Text report, one row per line; order by :func:`in_report_order`."""
    window = _text(F.col("window_start"), " - ", F.col("window_end"))
    header = F.concat(
        _lines(
            TITLE, _text(FULL_TITLE, F.col("run_date")), "",
            _text("Futtatás dátuma: ", F.col("run_date")),
            _text("Lookback: ", F.col("window_start"), " -> ", F.col("window_end")),
            _text("Feldolgozott lapszámok: ", F.col("issues_scanned")),
            _text("Új változások: ", F.col("new_items")), DOUBLE_RULE),
        _lines_if(F.col("new_items") == 0, _lines(
            NOTHING_NEW, _text("A figyelt időablak: ", window, "."))))
    footer = _lines(
        "", DOUBLE_RULE,
        _text(SOURCE, "Szűrési küszöb: relevancia >= ", score_text(F.col("threshold")), " (tág) · ",
              SUBJECT_AREA),
        "", _text("Generálva: ", F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ssxxx")))
    issue = F.concat(
        _lines("", _text(label_text(F.col("issue_number")), " (", F.col("issue_date"), ")")),
        _lines_if(_given("url"), _lines(_text(LINK_INTRO, F.col("url")))),
        _lines(RULE))
    item = F.concat(
        _lines(
            "", _text("§ ", F.col("anchor"), " — ", F.col("one_line_summary")),
            _text("  Relevancia: ", score_text(F.col("score"))),
            _text("  Témák: ", topics_text(F.col("matched_topics"))),
            "", _text("  ", F.col("expansion"))),
        _lines_if(_filled("key_dates"), _lines(
            "", _text("  Határidők: ", F.array_join("key_dates", ", ")))),
        _lines_if(_filled("action_items"), F.concat(
            _lines("", "  Teendők:"),
            F.transform("action_items", lambda a: F.concat(F.lit("    - "), a)))),
        _lines_if(_given("justification_url"), _lines(
            "", _text("  Indokolás: ", F.col("justification_url")))))
    return (
        _rows(runs, HEADER, 0, header)
        .unionByName(_rows(report_issues(items, links), BODY, 0, issue))
        .unionByName(_rows(items, BODY, 1, item))
        .unionByName(_rows(runs, FOOTER, 0, footer)))


def in_report_order(lines: DataFrame) -> DataFrame:
    """A global sort: Spark range-partitions it, so a long report is many tasks."""
    return lines.orderBy(*[way(name) for name, way in zip(LINE_KEYS, LINE_ORDER)])


def write_report(lines: DataFrame, runs: DataFrame, path: str) -> None:
    """UTF-8 text under run_date=...; the part files in name order are the report."""
    dated = lines.join(runs.select("run_id", "run_date"), "run_id")
    order = [way(name) for name, way in zip(LINE_KEYS, LINE_ORDER)]
    dated.orderBy("run_date", *order).select("run_date", F.col("line").alias("value")).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").text(path)


# -- HTML ----------------------------------------------------------------------

def _tag(name: str, *content: Column | str, css: str = "") -> Column:
    opening = f'<{name} class="{css}">' if css else f"<{name}>"
    return _text(opening, *content, f"</{name}>")


def _link(url: Column, label: Column | str) -> Column:
    return _text('<a href="', url, '">', label, "</a>")


def html_fragments(runs: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """HTML report, one row per fragment, same keys and order as the text lines."""
    safe = lambda name: escape_html(F.coalesce(F.col(name).cast("string"), F.lit("")))
    figures = _tag(
        "p", "Futtatás dátuma: ", safe("run_date"), " · Lookback: ", safe("window_start"), " → ",
        safe("window_end"), " · Feldolgozott lapszámok: ", safe("issues_scanned"),
        " · Új változások: ", safe("new_items"), css="figures")
    nothing = _tag(
        "p", NOTHING_NEW, " A figyelt időablak: ", safe("window_start"), " – ", safe("window_end"), ".",
        css="empty")
    header = F.concat(
        _lines(
            _text('<!doctype html><html lang="hu"><head><meta charset="utf-8">',
                  _tag("title", TITLE, " — ", safe("run_date")), "</head><body>"),
            _tag("h1", "HR Középvállalati — Magyar Közlöny Havi Riport"), figures),
        _lines_if(F.col("new_items") == 0, _lines(nothing)))
    footer = _lines(_text(
        _tag("p", SOURCE, "Szűrési küszöb: relevancia &ge; ", score_text(F.col("threshold")),
             " (tág) · ", SUBJECT_AREA, css="footer"), "</body></html>"))
    issue = F.concat(
        _lines(_tag("h2", escape_html(label_text(F.col("issue_number"))), " ",
                    _tag("span", safe("issue_date")))),
        _lines_if(_given("url"), _lines(_tag("p", LINK_INTRO, _link(safe("url"), safe("url"))))))
    badges = F.array_join(F.transform(
        F.coalesce("matched_topics", F.array().cast(NO_LINES)),
        lambda t: F.concat(F.lit('<span class="topic">'), escape_html(t), F.lit("</span>"))), "")
    dates = F.when(_filled("key_dates"), _tag(
        "p", "Határidők: ", F.array_join(F.transform("key_dates", escape_html), " · "), css="dates"))
    actions = F.when(_filled("action_items"), _tag("ul", F.array_join(F.transform(
        "action_items", lambda a: F.concat(F.lit("<li>"), escape_html(a), F.lit("</li>"))), "")))
    source = F.when(_given("justification_url"), _link(safe("justification_url"), "Indokolás megnyitása"))
    item = _lines(_tag(
        "div", F.concat_ws(
            "", _tag("h3", "§ ", safe("anchor"), " ", safe("one_line_summary")),
            _tag("p", "Relevancia: ", score_text(F.col("score")), " · ", badges, css="score"),
            _tag("p", safe("expansion")), dates, actions, source), css="item"))
    return (
        _rows(runs, HEADER, 0, header, "fragment")
        .unionByName(_rows(report_issues(items, links), BODY, 0, issue, "fragment"))
        .unionByName(_rows(items, BODY, 1, item, "fragment"))
        .unionByName(_rows(runs, FOOTER, 0, footer, "fragment")))


# -- outbox ----------------------------------------------------------------------

def outbox(runs: DataFrame, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """One message per run with news: subject, cover text, recipients, file names.

    Without attachments the cover is NULL: the report lines are the message. Delivery
    is the caller's.
    """
    name = _text(cfg.report_name + "-", F.col("run_date"))
    endings = [".txt", ".html"] if cfg.html_attachment else [".txt"]
    files = [_text(name, ending) for ending in endings] if cfg.attachment else []
    if cfg.html_attachment:
        attached = _text(
            "A részleteket két formátumban csatoltuk:\n  - ", name,
            ".txt (sima szöveg, bármilyen kliensben olvasható)\n  - ", name,
            ".html (színes, kattintható linkek, Outlook/Gmail/Webmail kliensben ajánlott)")
    else:
        attached = _text("Részletek a mellékelt fájlban: ", name, ".txt")
    cover = _text(
        TITLE + " — ", F.col("run_date"), "\n\nEbben a hónapban ", F.col("new_items"),
        " új, a HR területét (munkajog, bér, juttatás, foglalkoztatás, munkavédelem) érintő "
        "jogszabályváltozás jelent meg a Magyar Közlönyben.\n\n", attached,
        f"\n\n--\nAutomatikusan generálva · {cfg.product_name}\n")
    if not cfg.attachment:
        cover = F.lit(None).cast("string")
    recipients = F.transform(F.split(F.lit(cfg.email_to), ","), lambda a: F.trim(a))
    return runs.where("new_items > 0").select(
        "run_id", "run_date",
        _text(cfg.subject_prefix + " ", F.col("run_date"), " – ", F.col("new_items"),
              " új változás").alias("subject"),
        F.lit(cfg.email_from).alias("sender"), recipients.alias("recipients"), cover.alias("cover"),
        F.array(*files).cast(NO_LINES).alias("attachments"))
