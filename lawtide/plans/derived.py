"""Inputs of the checked queries, derived from the given tables.

One SQL text per view, written for Spark and DuckDB alike; `dialect` settles the few
differences. Every view has rows in proportion to the table it comes from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ("documents", "labels", "pages", "conversations", "events", "orders", "benchmark")

TEXT_TABLES = ("documents", "pages", "conversations")

LISTING_PAGE = 10

# What stands before and after the text of a section of a derived body, by kind.
BODY_BLOCKS = (
    ("<p>", "</p>"), ("<P class='x'>", "</P><p>vége</p>"),
    ("<p>kívül</p><div class=\"jogszabaly bekezdes\"><p>", "</p><div>belül</div></div>"), ("<ul><li>", "</li></ul>"),
)

# Tokens that differ between the two engines: (Spark, DuckDB).
TOKENS = {
    "ARRAY_OF(": ("array(", "list_value("),
    "TEXT_LIST": ("array<string>", "VARCHAR[]"),
    "LIST_SIZE(": ("size(", "len("),
}

_YEAR = "CAST(2010 + doc_id % 15 AS string)"
_N = f"CASE WHEN doc_id % {LISTING_PAGE} = 9 THEN doc_id - 1 WHEN doc_id % {LISTING_PAGE} = 0 AND doc_id > 0 THEN doc_id - {LISTING_PAGE} ELSE doc_id END"
_MONTHS = (
    "január,február,március,április,május,június,július,augusztus,szeptember,"
    "október,november,december,decemebr,brumaire"
)

VIEWS = {
    # Fields a listing entry is written from. Every tenth document repeats an entry of
    # its own page, every tenth one of the page before, some are bulletins or unnumbered.
    "v_entry": f"""
        SELECT doc_id, n, year_text, page_no,
               CASE WHEN doc_id % 17 = 3 THEN concat('Különszám ', CAST(n AS string))
                    ELSE concat(CASE WHEN doc_id % 10 = 5 THEN 'Hivatalos Értesítő ' ELSE 'Magyar Közlöny ' END,
                                year_text, '. évi ', CAST(n AS string), '. szám') END AS label,
               CASE WHEN doc_id % 4 = 1 THEN upper(date_text) ELSE date_text END AS date_text,
               CASE WHEN doc_id % 3 = 0 THEN concat('2024-0', CAST(doc_id % 9 + 1 AS string), '-',
                    lpad(CAST(doc_id % 28 + 1 AS string), 2, '0')) ELSE '' END AS meta_date,
               CASE doc_id % 4
                    WHEN 0 THEN concat('/dokumentumok/d', CAST(n AS string), '/megtekintes')
                    WHEN 1 THEN concat('/hivatalos-lapok/k', CAST(n AS string), '/dokumentumok/d', CAST(n AS string), '/megtekintes')
                    WHEN 2 THEN concat('https://gazette.example.org/dokumentumok/d', CAST(n AS string), '/megtekintes')
                    ELSE concat('../dokumentumok/d', CAST(n AS string), '/megtekintes') END AS href,
               doc_id % 3 = 1 AS justified
        FROM (SELECT doc_id, {_N} AS n, CAST(2010 + ({_N}) % 15 AS string) AS year_text,
                     CAST(floor(doc_id / {LISTING_PAGE}) AS bigint) + 1 AS page_no,
                     concat({_YEAR}, '. ', split_part('{_MONTHS}', ',', CAST(doc_id % 14 + 1 AS int)), ' ',
                            CAST(doc_id % 31 + 1 AS string), '.') AS date_text
              FROM documents) t
    """,
    # Paragraphs with issue attributes; anchors collide on purpose.
    "v_key": f"""
        SELECT doc_id, lang, pos, text, concat({_YEAR}, '/', CAST(doc_id AS string)) AS issue_id,
               concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Magyar Közlöny ' END, {_YEAR}, '. évi ',
                      CAST(doc_id AS string), '. szám') AS issue_number,
               make_date(2024, CAST(doc_id % 12 + 1 AS int), CAST(doc_id % 28 + 1 AS int)) AS issue_date,
               concat(CAST(pos % 4 + 1 AS string), '. §') AS anchor
        FROM v_par
    """,
    # Issues as parsed, one per document.
    "v_issue": f"""
        SELECT doc_id, concat({_YEAR}, '/', CAST(doc_id AS string)) AS issue_id,
               concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Magyar Közlöny ' END, {_YEAR}, '. évi ',
                      CAST(doc_id AS string), '. szám') AS issue_number,
               make_date(2024, CAST(doc_id % 12 + 1 AS int), CAST(doc_id % 28 + 1 AS int)) AS issue_date,
               doc_id % 3 = 1 AS has_justification, lang,
               concat('https://example.org/dokumentumok/d', CAST(doc_id AS string), '/megtekintes') AS view_url
        FROM documents
    """,
    # Scored paragraphs: flag, score, topics and texts follow from the length.
    "v_scored": """
        SELECT doc_id, issue_id, issue_number, issue_date, anchor, pos, text,
               length(text) % 3 <> 0 AS is_relevant,
               CAST(length(text) % 101 AS double) / 100 AS score,
               CASE length(text) % 4 WHEN 0 THEN CAST(ARRAY_OF() AS TEXT_LIST) WHEN 1 THEN ARRAY_OF('bér')
                    ELSE ARRAY_OF('bér', 'szja') END AS matched_topics,
               substring(text, 1, CAST(length(text) % 200 AS int)) AS one_line_summary,
               concat('R ', substring(text, 1, CAST(length(text) % 900 AS int))) AS expansion,
               CASE WHEN length(text) % 5 = 0 THEN ARRAY_OF('2024. január 1.', concat('2024. ', CAST(length(text) AS string)))
                    ELSE CAST(ARRAY_OF() AS TEXT_LIST) END AS key_dates,
               CASE length(text) % 7 WHEN 0 THEN CAST(ARRAY_OF() AS TEXT_LIST) WHEN 1 THEN ARRAY_OF('a', 'b', 'c', 'd')
                    ELSE ARRAY_OF('HR: ellenőrizni', substring(text, 1, 130)) END AS action_items,
               CASE WHEN doc_id % 3 = 1 THEN concat('https://example.org/', CAST(doc_id AS string), '/indokolas') END AS justification_url,
               CASE WHEN length(text) % 13 = 0 THEN 'parse_failed_after_repair' END AS error
        FROM v_key
    """,
    "v_reported": "SELECT DISTINCT issue_number, anchor FROM v_key WHERE lang = 'de'",
    "v_progress": "SELECT issue_id, issue_date FROM v_issue WHERE lang = 'es'",
    "v_items": """
        SELECT 'run' AS run_id, * FROM v_scored WHERE is_relevant AND score >= 0.5 AND length(text) > 0
    """,
    # One run per event.
    "v_runs": """
        SELECT concat('r', lpad(CAST(event_id AS string), 12, '0')) AS run_id, CAST(ts AS date) AS run_date,
               ts AS run_ts, event_id % 7 AS persisted, event_id % 5 AS new_items, event_id % 50 AS issues_scanned,
               CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CAST(CAST(ts AS date) AS string) END AS run_date_text,
               CAST(event_id % 100 AS double) / 100 AS threshold
        FROM events
    """,
    # Model replies built from labels, malformed ones included.
    "v_reply": r"""
        SELECT doc_id, CASE doc_id % 12
          WHEN 0 THEN concat('```json', chr(10), j, chr(10), '```')
          WHEN 1 THEN concat('Answer: ', j, ' end')
          WHEN 2 THEN '{"is_relevant": true, "one_line_summary_hu": "a "b" c", "score": 0.9}'
          WHEN 3 THEN concat('{"is_relevant": true, "one_line_summary_hu": "a', chr(10), 'b", "score": 0.9}')
          WHEN 4 THEN concat('{"is_relevant": true, "score": "0.', CAST(doc_id % 90 + 10 AS string), '"}')
          WHEN 5 THEN '{}'
          WHEN 6 THEN '{"is_relevant": true, "score": 1.7, "reasoning_hu": "indoklás"}'
          WHEN 7 THEN concat('[', j, ']')
          WHEN 8 THEN concat('  ', CAST(doc_id AS string), '  ')
          WHEN 9 THEN '{"is_relevant": false, "score": null, "matched_topics": "oops"}'
          WHEN 10 THEN concat('{"is_relevant": true, "score": "high", "matched_topics": ["a", "b"]} {', j)
          ELSE j END AS reply
        FROM (SELECT doc_id, concat('{"is_relevant": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END,
              ', "score": 0.', lpad(CAST(doc_id % 100 AS string), 2, '0'),
              ', "matched_topics": ["t', CAST(doc_id % 14 AS string), '"], "one_line_summary_hu": "s',
              CAST(doc_id AS string), '"}') AS j FROM labels) t
    """,
    "v_enriched": r"""
        SELECT doc_id, concat('fallback ', CAST(doc_id AS string)) AS one_line_summary, CASE doc_id % 5
          WHEN 0 THEN concat('{"expansion_hu": "e', CAST(doc_id AS string), '", "key_dates_hu": ["2024. január 1."], "action_items_hu": ["x", "y"]}')
          WHEN 1 THEN '{"key_dates_hu": "oops", "action_items_hu": 42}'
          WHEN 2 THEN concat('```', chr(10), '{"expansion_hu": "f", "action_items_hu": ["', CAST(doc_id AS string), '"]}', chr(10), '```')
          WHEN 3 THEN 'no json at all'
          ELSE '{"key_dates_hu": [], "action_items_hu": []}' END AS reply
        FROM labels
    """,
}

# v_par differs in the table function, so it is written twice.
V_PAR = {
    "duck": """
        SELECT doc_id, lang, CAST(unnest(range(len(string_split(text, chr(10))))) AS bigint) AS pos,
               unnest(string_split(text, chr(10))) AS text
        FROM documents
    """,
}


def dialect(sql: str, engine: str) -> str:
    for token, forms in TOKENS.items():
        sql = sql.replace(token, forms[0 if engine == "spark" else 1])
    return sql


def with_views(sql: str) -> str:
    """DuckDB text of a query with the views it names, as common table expressions."""
    texts = {"v_par": V_PAR["duck"], **{n: dialect(t, "duck") for n, t in VIEWS.items()}}
    texts["v_listing"] = f"""
        SELECT page_no, concat('<html><body>', string_agg({entry_sql()}, '' ORDER BY doc_id), '</body></html>') AS html
        FROM v_entry GROUP BY page_no
    """
    needed: list[str] = []

    def need(text: str) -> None:
        for name in texts:
            if name in text and name not in needed:
                need(texts[name])
                needed.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({texts[n]})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def entry_sql() -> str:
    """Markup of one listing entry."""
    return """concat('<div class="fresh-row"><a class="t" href="', href, '"><b itemprop="name">', label,
        '</b></a><span>', date_text, '</span>',
        CASE WHEN meta_date <> '' THEN concat('<meta content="', meta_date, '" itemprop="datePublished"/>') ELSE '' END,
        CASE WHEN justified THEN concat('<a href="/Indoklasok/x', CAST(n AS string), '"> »Indokolások</a>') ELSE '' END,
        '</div>')"""


class Tables:
    """The given tables and derived views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "v_par":
            return self.documents.select(
                "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"),
            ).withColumn("pos", F.col("pos").cast("long"))
        if name == "v_body":
            # A heading a line of the text; below it paragraphs, a box with nested blocks, or none.
            line = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
                F.format_string("<h%d class=\"c\">%d. § cím</h%d>", i % 4 + 1, i + 1, i % 4 + 1),
                F.element_at(F.array(*[F.concat(F.lit(a), F.translate(x, "<>&", ""), F.lit(b)) for a, b in BODY_BLOCKS]),
                             ((F.col("doc_id") + i) % 4).cast("int") + 1)))
            return self.documents.select("doc_id", F.concat(
                F.lit("<html><body>"), F.array_join(line, ""), F.lit("</body></html>")).alias("html"))
        if name == "v_listing":
            # At most LISTING_PAGE entries are gathered per page.
            entries = self.v_entry.withColumn("entry", F.expr(entry_sql()))
            joined = entries.groupBy("page_no").agg(
                F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("e"))
            return joined.select("page_no", F.concat(
                F.lit("<html><body>"), F.array_join("e.entry", ""), F.lit("</body></html>")).alias("html"))
        sql = dialect(VIEWS[name], "spark")
        named = {}
        for source in (*TABLES, "v_par", *VIEWS):
            if f"FROM {source}" in sql:
                named[source] = f"lawtide_{source}_{uuid.uuid4().hex}"
                getattr(self, source).createOrReplaceTempView(named[source])
                sql = sql.replace(f"FROM {source}", f"FROM {named[source]}")
        made = self.spark.sql(sql)
        # The plan is resolved; leave nothing behind in the caller's session.
        for view in named.values():
            self.spark.catalog.dropTempView(view)
        return made
