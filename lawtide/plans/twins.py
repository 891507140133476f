"""SQL twins of the checked queries, for DuckDB."""

from __future__ import annotations

from lawtide.functions import requests
from lawtide.functions.anchors import UNKNOWN_ANCHOR
from lawtide.functions.text import PLAIN_ENTITIES, high_half
from lawtide.plans import report
from lawtide.plans.catalog import ANCHOR_SAMPLE, BASE_URL, LATIN_SCOPE, MAIL, STRICT_SCOPE, TABLE_SCOPE
from lawtide.plans.derived import with_views

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>"
INVISIBLE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>"
BLOCK = (
    r"(?i)(</?(?:h[1-6]|p|div|li|ul|ol|dl|dt|dd|nav|article|section|header|footer|main|aside|"
    r"form|table|thead|tbody|tr|td|th|blockquote|pre|hr|figure|body|html)\b[^>]*>)"
)


def q(value: str) -> str:
    """A string literal; line breaks are written as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return parts[0] if len(parts) == 1 else "concat(" + ", chr(10), ".join(parts) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def decoded(x: str) -> str:
    # The entities that occur in the tables; the ampersand last.
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def node(x: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({x}, '{TAG}'), lambda p: {strip(decoded('p'))})"
    return f"array_to_string(list_filter({pieces}, lambda p: p <> ''), ' ')"


def hit(x: str, stems) -> str:
    return rf"regexp_matches(lower({x}), '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(stems)})')"


def topics(x: str, scope) -> str:
    found = ", ".join(
        f"CASE WHEN {hit(x, stems)} THEN '{name}' END" for name, stems in sorted(scope.topics.items()))
    return f"list_filter([{found}], lambda t: t IS NOT NULL)"


def lexical(tags: str) -> str:
    return f"CAST(least(10, 4 + 2 * len({tags})) AS double) / 10"


def score_text(x: str) -> str:
    return f"printf('%.2f', {x})"


def topics_text(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN '(nincs)' ELSE array_to_string({x}, ', ') END"


def label_text(x: str) -> str:
    return f"CASE WHEN starts_with({x}, 'Magyar Közlöny') THEN {x} ELSE concat('Magyar Közlöny ', {x}) END"


def anchor(x: str) -> str:
    """Leftmost of the three marks: the shortest text before a match wins."""
    pattern = rf"([0-9]{{1,3}})\.{WS}*§|(?:^|[^\p{{L}}\p{{N}}_])([IVX]{{1,5}})\.{WS}*(?:fejezet|cím|alcím|rész)(?:$|[^\p{{L}}\p{{N}}_])|(\([1-9][0-9]?\))"
    g = [f"coalesce(regexp_extract({x}, '{pattern}', {i}), '')" for i in (1, 2, 3)]
    return (f"CASE WHEN {g[0]} <> '' THEN concat({g[0]}, '. §') WHEN {g[1]} <> '' THEN concat({g[1]}, '. fejezet') "
            f"WHEN {g[2]} <> '' THEN {g[2]} END")


def paragraph_anchor(x: str) -> str:
    return f"coalesce({anchor(x)}, nullif(substring({x}, 1, 40), ''), '{UNKNOWN_ANCHOR}')"


def sections(source: str, key: str, html: str = "html") -> str:
    """(key, section, heading, text) of `source`."""
    visible = f"regexp_replace({html}, '{INVISIBLE}', '', 'g')"
    marked = rf"regexp_replace({visible}, '{BLOCK}', chr(1) || '\1', 'g')"
    cut = rf"string_split(regexp_replace({marked}, chr(1) || '((?i)<h[1-4]\b)', chr(2) || '\1', 'g'), chr(2))"
    paras = r"list_filter(blocks, lambda b: regexp_matches(b, '(?i)^<(?:p\b|div\b[^>]*\bclass\s*=\s*(?:""[^""]*bekezdes|''[^'']*bekezdes))'))".replace('""', '"')
    return f"""
        SELECT {key}, section, heading, text FROM (
          SELECT {key}, section, CASE WHEN section = 0 THEN '' ELSE {node('blocks[1]')} END AS heading,
                 array_to_string(list_transform({paras}, lambda b: {node('b')}), '') AS text
          FROM (SELECT {key}, section, string_split(markup, chr(1)) AS blocks FROM (
            SELECT {key}, CAST(unnest(range(len(c))) AS bigint) AS section, unnest(c) AS markup
            FROM (SELECT {key}, {cut} AS c FROM {source}) a) b) d) e
        WHERE {strip('text')} <> ''
    """


# Sections of the derived bodies, from what they are written from.
BODY_SECTIONS = f"""
    SELECT -1 - doc_id AS page_id, pos + 1 AS section, concat(pos + 1, '. § cím') AS heading, text FROM (
      SELECT doc_id, pos, CASE (doc_id + pos) % 4 WHEN 0 THEN t WHEN 1 THEN concat(t, 'vége')
             WHEN 2 THEN concat('kívül', t, CASE WHEN t <> '' THEN ' ' ELSE '' END, 'belül') ELSE '' END AS text
      FROM (SELECT doc_id, pos, {strip("translate(text, '<>&', '')")} AS t FROM v_par) x) y
    WHERE text <> ''
"""

ORDINAL = "row_number() OVER (PARTITION BY page_id ORDER BY section) - 1"
LINES = "SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS bigint) AS pos, {x} AS text FROM documents"
CHUNKS = f"""
    SELECT doc_id, pos, coalesce({anchor('text')}, concat('p', pos)) AS anchor, text
    FROM (SELECT doc_id, pos, {strip('text')} AS text FROM ({LINES.format(x="unnest(string_split(text, chr(10)))")}) a) b
    WHERE length(text) >= 30
"""

# Expected fields of a listing entry, from what it was written from.
ENTRY_ROWS = rf"""
    SELECT doc_id, page_no, label AS issue_number, regexp_matches(label, '[0-9]{{4}}\. évi [0-9]+\. szám') AS numbered,
           concat(year_text, '/', n) AS issue_id,
           coalesce(TRY_CAST(nullif(meta_date, '') AS date), {{local}}) AS issue_date, justified,
           concat(CASE WHEN doc_id % 4 = 2 THEN 'https://gazette.example.org' ELSE '{BASE_URL}' END,
                  '/dokumentumok/d', n, '/megtekintes') AS view_url
    FROM v_entry
"""
MONTH_NUMBERS = (
    "január 1 február 2 március 3 április 4 május 5 június 6 július 7 augusztus 8 szeptember 9 "
    "október 10 november 11 december 12 decemebr 12"
).split()


def local_date(x: str) -> str:
    names = MONTH_NUMBERS[::2]
    pattern = rf"(?i)([0-9]{{4}})\.{WS}*({'|'.join(names)}){WS}*([0-9]{{1,2}})"
    g = [f"regexp_extract({x}, '{pattern}', {i})" for i in (1, 2, 3)]
    month = "CASE lower(" + g[1] + ") " + " ".join(
        f"WHEN '{n}' THEN '{int(m):02d}'" for n, m in zip(names, MONTH_NUMBERS[1::2])) + " END"
    return f"TRY_CAST(concat({g[0]}, '-', nullif({month}, ''), '-', lpad({g[2]}, 2, '0')) AS date)"


ENTRIES = ENTRY_ROWS.replace("{local}", local_date("date_text"))
LISTED = f"SELECT * FROM ({ENTRIES}) z WHERE numbered AND NOT contains(issue_number, 'Hivatalos Értesítő')"

# Strict reading of replies.
BODY = strip(f"regexp_replace({strip('reply')}, '(?i)^```(?:json)?{WS}*|{WS}*```$', '', 'g')")
PARSED = f"""
    SELECT *, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'OBJECT' THEN body END
                   WHEN json_valid(span) AND json_type(span) = 'OBJECT' THEN span END AS j
    FROM (SELECT *, nullif(regexp_extract(body, '(?s)\\{{.*\\}}', 0), '') AS span
          FROM (SELECT *, {BODY} AS body FROM {{source}}) a) b
"""
REPLIES = PARSED.replace("{source}", "v_reply")
ENRICHED = PARSED.replace("{source}", "v_enriched")


def json_list(x: str, key: str) -> str:
    return (f"CASE WHEN json_type({x}, '$.{key}') = 'ARRAY' "
            f"THEN array_to_string(from_json(json_extract({x}, '$.{key}'), '[\"VARCHAR\"]'), '|') ELSE '' END")


SCORE = "greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(j, '$.score') AS double), 0.0)))"
COERCED = f"""
    SELECT doc_id, j IS NULL AS bad, coalesce(json_extract_string(j, '$.is_relevant') = 'true', false) AS is_relevant,
           CAST({SCORE} AS double) AS score, {json_list('j', 'matched_topics')} AS matched_topics,
           coalesce(json_extract_string(j, '$.one_line_summary_hu'), '') AS one_line_summary,
           coalesce(json_extract_string(j, '$.reasoning_hu'), '') AS reasoning
    FROM ({REPLIES}) r
"""


def request(text: str, context: str) -> str:
    blank = f"{strip(f'coalesce({context}, {q(str())})')} = ''"
    return f"""concat('Bekezdés szövege:', chr(10), '<<<', chr(10), {strip(text)}, chr(10), '>>>',
        CASE WHEN {blank} THEN '' ELSE concat(chr(10), chr(10), 'Indokolás (kontextus):', chr(10), '<<<', chr(10),
        {strip(context)}, chr(10), '>>>') END, {q(requests.SCORE_SUFFIX)})"""


CANDIDATES = f"SELECT * FROM v_key WHERE length(text) >= 30 AND {hit('text', TABLE_SCOPE.all_stems)}"
ASKED = f"SELECT *, length({request('text', q(''))}) AS n FROM ({CANDIDATES}) c"
# Length of the repair request: that of its fixed words and of the malformed reply in it.
REPAIR_FIXED = len(requests.REPAIR["score"])
MALFORMED = len('{"is_relevant": true, "one_line_summary_hu": "a "b""}')
REPAIR_BROKEN = f"({REPAIR_FIXED + MALFORMED} + n % 8) % 2 = 1"

FIRST_ITEMS = """SELECT * FROM v_items QUALIFY row_number() OVER (PARTITION BY issue_number, anchor ORDER BY issue_id, pos) = 1"""
LINKS = "SELECT issue_number, view_url AS url FROM v_issue WHERE lang <> 'es'"
FIGURES = "SELECT count(DISTINCT issue_id) AS issues_scanned, count(*) AS new_items FROM v_items"


def numbered(rows: str, part: int, level: int, value: str = "line") -> str:
    """(part, keys, level, line_no, value) from rows with an array `lines`."""
    return f"""SELECT CAST({part} AS bigint) AS part, CAST(issue_date AS varchar) AS issue_date, issue_number,
        CAST({level} AS bigint) AS level, anchor, CAST(pos AS bigint) AS pos,
        CAST(unnest(range(len(lines))) AS bigint) AS line_no, unnest(lines) AS {value} FROM ({rows}) x"""


NO_KEYS = "NULL::date AS issue_date, NULL::varchar AS issue_number, NULL::varchar AS anchor, NULL::bigint AS pos"
REPORT_ISSUES = f"""SELECT i.issue_number, i.issue_date, NULL::varchar AS anchor, NULL::bigint AS pos, l.url
    FROM (SELECT DISTINCT issue_number, issue_date FROM v_items) i LEFT JOIN ({LINKS}) l ON i.issue_number = l.issue_number"""
RULE, DOUBLE_RULE = q(report.RULE), q(report.DOUBLE_RULE)

HEADER_LINES = f"""SELECT {NO_KEYS}, list_concat([{q(report.TITLE)}, {q(report.FULL_TITLE + '2024-07-02')}, '',
    'Futtatás dátuma: 2024-07-02', 'Lookback: 2024-06-02 -> 2024-07-02',
    concat('Feldolgozott lapszámok: ', issues_scanned), concat('Új változások: ', new_items), {DOUBLE_RULE}],
    CASE WHEN new_items = 0 THEN [{q(report.NOTHING_NEW)}, 'A figyelt időablak: 2024-06-02 - 2024-07-02.'] ELSE [] END)
    AS lines FROM ({FIGURES}) f"""
FOOTER_LINES = f"""SELECT {NO_KEYS}, ['', {DOUBLE_RULE},
    {q(report.SOURCE + 'Szűrési küszöb: relevancia >= 0.50 (tág) · ' + report.SUBJECT_AREA)}, '',
    'Generálva: 2024-07-02T08:00:00+00:00'] AS lines"""
ISSUE_LINES = f"""SELECT issue_date, issue_number, anchor, pos, list_concat(
    ['', concat({label_text('issue_number')}, ' (', issue_date, ')')],
    CASE WHEN url IS NOT NULL THEN [concat({q(report.LINK_INTRO)}, url)] ELSE [] END, [{RULE}]) AS lines
    FROM ({REPORT_ISSUES}) r"""
ITEM_LINES = f"""SELECT issue_date, issue_number, anchor, pos, list_concat(
    ['', concat('§ ', anchor, ' — ', one_line_summary), concat('  Relevancia: ', {score_text('score')}),
     concat('  Témák: ', {topics_text('matched_topics')}), '', concat('  ', expansion)],
    CASE WHEN len(key_dates) > 0 THEN ['', concat('  Határidők: ', array_to_string(key_dates, ', '))] ELSE [] END,
    CASE WHEN len(action_items) > 0 THEN list_concat(['', '  Teendők:'],
      list_transform(action_items, lambda a: concat('    - ', a))) ELSE [] END,
    CASE WHEN justification_url IS NOT NULL THEN ['', concat('  Indokolás: ', justification_url)] ELSE [] END) AS lines
    FROM v_items"""
REPORT = " UNION ALL ".join([
    numbered(HEADER_LINES, 0, 0), numbered(ISSUE_LINES, 1, 0), numbered(ITEM_LINES, 1, 1), numbered(FOOTER_LINES, 2, 0)])


def escaped(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


HTML = " UNION ALL ".join([
    numbered(f"""SELECT {NO_KEYS}, list_concat([
        '<!doctype html><html lang="hu"><head><meta charset="utf-8"><title>{report.TITLE} — 2024-07-02</title></head><body>',
        '<h1>HR Középvállalati — Magyar Közlöny Havi Riport</h1>',
        concat('<p class="figures">Futtatás dátuma: 2024-07-02 · Lookback: 2024-06-02 → 2024-07-02 · Feldolgozott lapszámok: ',
               issues_scanned, ' · Új változások: ', new_items, '</p>')],
        CASE WHEN new_items = 0 THEN [concat('<p class="empty">', {q(report.NOTHING_NEW)},
            ' A figyelt időablak: 2024-06-02 – 2024-07-02.</p>')] ELSE [] END) AS lines FROM ({FIGURES}) f""", 0, 0, "fragment"),
    numbered(f"""SELECT issue_date, issue_number, anchor, pos, list_concat(
        [concat('<h2>', {escaped(label_text('issue_number'))}, ' <span>', issue_date, '</span></h2>')],
        CASE WHEN url IS NOT NULL THEN [concat('<p>', {q(report.LINK_INTRO)}, '<a href="', {escaped('url')}, '">',
            {escaped('url')}, '</a></p>')] ELSE [] END) AS lines FROM ({REPORT_ISSUES}) r""", 1, 0, "fragment"),
    numbered(f"""SELECT issue_date, issue_number, anchor, pos, [concat('<div class="item"><h3>§ ', {escaped('anchor')}, ' ',
        {escaped('one_line_summary')}, '</h3><p class="score">Relevancia: ', {score_text('score')}, ' · ',
        array_to_string(list_transform(matched_topics, lambda t: concat('<span class="topic">', {escaped('t')}, '</span>')), ''),
        '</p><p>', {escaped('expansion')}, '</p>',
        CASE WHEN len(key_dates) > 0 THEN concat('<p class="dates">Határidők: ',
            array_to_string(list_transform(key_dates, lambda d: {escaped('d')}), ' · '), '</p>') ELSE '' END,
        CASE WHEN len(action_items) > 0 THEN concat('<ul>',
            array_to_string(list_transform(action_items, lambda a: concat('<li>', {escaped('a')}, '</li>')), ''), '</ul>') ELSE '' END,
        CASE WHEN justification_url IS NOT NULL THEN concat('<a href="', {escaped('justification_url')},
            '">Indokolás megnyitása</a>') ELSE '' END, '</div>')] AS lines FROM v_items""", 1, 1, "fragment"),
    numbered(f"""SELECT {NO_KEYS}, ['<p class="footer">{report.SOURCE}Szűrési küszöb: relevancia &ge; 0.50 (tág) · {report.SUBJECT_AREA}</p></body></html>']
        AS lines""", 2, 0, "fragment"),
])

FLAGS = f"""
    SELECT *, kept AND {hit('text', TABLE_SCOPE.all_stems)} AS candidate FROM (
      SELECT k.*, r.anchor IS NOT NULL AS reported, length(k.text) >= 30 AS kept FROM v_key k
      LEFT JOIN v_reported r ON k.issue_number = r.issue_number AND k.anchor = r.anchor) a
"""
LATIN_KEEP = "[^\\x00-\\x7f" + high_half("iso-8859-2")[0x20:] + "]"


def html_text(x: str) -> str:
    for pattern, to in (
        ("(?is)<style[^>]*>.*?</style>", "''"), ("(?is)<script[^>]*>.*?</script>", "''"),
        (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</p>|</div>|</li>|</h\d>", "chr(10)"), ("<[^>]+>", "''"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    for entity, char in PLAIN_ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(char)})"
    for pattern, to in ((r"[ \t]+", "' '"), (r"\n[ \t]+", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return strip(x)


def json_text(x: str) -> str:
    return f"concat('[', array_to_string(list_transform({x}, lambda v: CAST(to_json(v) AS varchar)), ', '), ']')"


def scope_rows(scope) -> str:
    return f"""SELECT doc_id, pos, '{scope.name}' AS scope, array_to_string(tags, '|') AS topics, {lexical('tags')} AS score
        FROM (SELECT doc_id, pos, {topics('text', scope)} AS tags FROM v_par WHERE {hit('text', scope.all_stems)}) s
        WHERE {lexical('tags')} >= {scope.threshold}"""


# Unsigned CRC-32 of `word`.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(word, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, i: xor(e >> 1, (e & 1) * 3988292384))), 4294967295)"""

COVER = f"""concat('{report.TITLE} — ', run_date, chr(10), chr(10), 'Ebben a hónapban ', new_items,
    ' új, a HR területét (munkajog, bér, juttatás, foglalkoztatás, munkavédelem) érintő jogszabályváltozás jelent meg a Magyar Közlönyben.',
    chr(10), chr(10), 'A részleteket két formátumban csatoltuk:', chr(10), '  - report-', run_date,
    '.txt (sima szöveg, bármilyen kliensben olvasható)', chr(10), '  - report-', run_date,
    '.html (színes, kattintható linkek, Outlook/Gmail/Webmail kliensben ajánlott)', chr(10), chr(10), '--', chr(10),
    'Automatikusan generálva · {MAIL.product_name}', chr(10))"""

PAGE_STARTS = """coalesce(CAST(sum(length(trim(text, chr(10))) + 2) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0)"""
PAGE_CHUNKS = f"""
    SELECT issue_id, pos, coalesce({anchor('text')}, concat('p', pos)) AS anchor, text FROM (
      SELECT issue_id, CAST(unnest(range(1, len(c) + 1)) AS bigint) AS pos, {strip('unnest(c)')} AS text FROM (
        SELECT conv_id AS issue_id, string_split(string_agg(trim(text, chr(10)), chr(10) || chr(10) ORDER BY turn), chr(10)) AS c
        FROM conversations GROUP BY conv_id) a) b
    WHERE length(text) >= 30
"""

RUN_PARAGRAPHS = f"""
    WITH issues AS (SELECT * FROM (SELECT * FROM (SELECT * FROM ({LISTED}) e
            QUALIFY row_number() OVER (PARTITION BY page_no, issue_id ORDER BY doc_id) = 1) f
          WHERE issue_date BETWEEN DATE '2023-10-01' AND DATE '2024-09-30'
          QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY page_no DESC) = 1) g),
      found AS (SELECT concat(2010 + page_id % 15, '/', page_id) AS issue_id, section, {paragraph_anchor('heading')} AS anchor, text
        FROM ({sections('pages', 'page_id')}) s),
      first_text AS (SELECT issue_id, arg_min(text, section) AS context FROM found GROUP BY 1),
      chunked AS (SELECT concat(2010 + doc_id % 15, '/', doc_id) AS issue_id, 1 AS section, coalesce({anchor('t')}, 'p1') AS anchor, t AS text
        FROM (SELECT doc_id, {strip('text')} AS t FROM documents) d),
      every AS (SELECT * FROM found UNION ALL SELECT * FROM chunked WHERE issue_id NOT IN (SELECT issue_id FROM found))
    SELECT i.issue_number, v.anchor, concat(v.text, chr(10), CASE WHEN i.justified THEN coalesce(c.context, '') ELSE '' END) AS searched
    FROM every v JOIN issues i ON v.issue_id = i.issue_id LEFT JOIN first_text c ON v.issue_id = c.issue_id
    WHERE length(v.text) >= 30
"""


def run_row(scope) -> str:
    """Figures of a whole run of one scope."""
    return f"""SELECT '{scope.name}' AS scope,
        (SELECT count(*) FROM (SELECT DISTINCT issue_id FROM (SELECT * FROM ({LISTED}) e
            QUALIFY row_number() OVER (PARTITION BY page_no, issue_id ORDER BY doc_id) = 1) f
          WHERE issue_date BETWEEN DATE '2023-10-01' AND DATE '2024-09-30'
          QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY page_no DESC) = 1) g) AS issues_scanned,
        count(*) AS paragraphs, count(*) FILTER (hit) AS candidates, count(*) FILTER (relevant) AS relevant,
        count(*) FILTER (relevant) AS new_items, count(DISTINCT (issue_number, anchor)) FILTER (relevant) AS persisted
        FROM (SELECT *, hit AND {lexical('tags')} >= {scope.threshold} AS relevant FROM (
          SELECT *, {hit('searched', scope.all_stems)} AS hit, {topics('searched', scope)} AS tags
          FROM ({RUN_PARAGRAPHS}) p) q) r"""


STATE_ITEMS = """SELECT *, CASE WHEN score >= 0.75 THEN 1 ELSE 2 END AS round,
    min(CASE WHEN score >= 0.75 THEN 1 ELSE 2 END) OVER (PARTITION BY issue_number, anchor) AS inserted FROM v_items"""

TWINS: dict[str, str] = {
    "a1_reachable_pages": """SELECT page_id + 1 AS page_no, url, length(html) AS n_chars FROM pages
        WHERE page_id < (SELECT max(page_id) - 3 FROM pages)
        AND page_id <= coalesce((SELECT min(page_id) FROM pages WHERE NOT contains(html, 'href="/')), 9223372036854775807)""",
    "a2_issue_bodies": """SELECT i.issue_id, i.issue_number, md5(p.html) AS body FROM pages p
        JOIN v_issue i ON p.page_id = i.doc_id""",
    "a3_page_texts": f"""SELECT conv_id AS issue_id, turn AS page_no, {PAGE_STARTS} AS start,
        trim(text, chr(10)) AS page_text FROM conversations""",
    "a3_page_chunks": PAGE_CHUNKS,
    "a4_decoded": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '{LATIN_KEEP}', '?', 'g')
        ELSE html END AS html FROM pages""",
    "a5_source_fallback": f"""WITH html_rows AS (SELECT page_id, {ORDINAL} AS pos, {paragraph_anchor('heading')} AS anchor, text
          FROM ({sections("(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS html FROM pages) src", 'page_id')}) s)
        SELECT * FROM html_rows UNION ALL
        SELECT doc_id AS page_id, pos, anchor, text FROM ({CHUNKS}) c WHERE doc_id NOT IN (SELECT page_id FROM html_rows)""",
    "b1_links": """SELECT page_id, CAST(unnest(range(len(h))) AS bigint) AS pos, unnest(h) AS href FROM (
        SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS h FROM pages) t""",
    "b2_urls": f"SELECT doc_id, view_url FROM ({ENTRIES}) e",
    "b3_derived_urls": """SELECT doc_id, replace(view_url, '/megtekintes', '/letoltes') AS pdf_url,
        CASE WHEN has_justification THEN replace(view_url, '/megtekintes', '/indokolas') END AS justification_url FROM v_issue""",
    "b4_issue_ids": f"SELECT doc_id, issue_id FROM ({ENTRIES}) e WHERE numbered",
    "b5_labels": "SELECT page_no, label AS issue_number FROM v_entry",
    "b6_dates": f"SELECT page_no, issue_id, CAST(issue_date AS varchar) AS issue_date FROM ({LISTED}) e WHERE issue_date IS NOT NULL",
    "b7_local_dates": f"SELECT doc_id, CAST({local_date('date_text')} AS varchar) AS issue_date FROM v_entry",
    "b8_justified": f"""SELECT page_no, issue_id, justified AS has_justification,
        CASE WHEN justified THEN replace(view_url, '/megtekintes', '/indokolas') END AS justification_url FROM ({LISTED}) e""",
    "b9_sections": f"SELECT * FROM ({sections('pages', 'page_id')}) s UNION ALL {BODY_SECTIONS}",
    "b10_paragraphs": f"""SELECT page_id, {ORDINAL} AS pos, {paragraph_anchor('heading')} AS anchor FROM ({sections('pages', 'page_id')}) s
        UNION ALL SELECT page_id, {ORDINAL} AS pos, concat(section, '. §') AS anchor FROM ({BODY_SECTIONS}) b""",
    "b11_anchors": f"""SELECT doc_id, pos, {anchor('heading')} AS anchor, {paragraph_anchor('text')} AS paragraph_anchor
        FROM (SELECT *, {ANCHOR_SAMPLE} AS heading FROM v_par) p""",
    "b12_chunks": CHUNKS,
    "b13_html_text": f"SELECT page_id, {html_text('html')} AS text FROM pages",
    "b14_json_payload": f"SELECT doc_id, body, span FROM ({REPLIES}) r",
    "b15_strict_json": f"""SELECT doc_id, j IS NOT NULL AS parsed,
        coalesce(json_valid(reply) AND json_type(CASE WHEN json_valid(reply) THEN reply END) = 'OBJECT', false) AS whole FROM ({REPLIES}) r""",
    "c1_content_hash": f"SELECT doc_id, sha256({squeeze('lower(text)')}) AS content_hash FROM documents",
    "c2_keyword_match": f"SELECT doc_id, pos, {hit('text', TABLE_SCOPE.all_stems)} AS hit FROM v_par",
    "c3_topics": f"SELECT doc_id, pos, array_to_string({topics('text', TABLE_SCOPE)}, '|') AS topics FROM v_par",
    "c4_searched_text": """SELECT doc_id, md5(lower(concat(text, chr(10), CASE WHEN lang = 'en' THEN source ELSE '' END))) AS searched
        FROM documents""",
    "c5_score_defaults": f"""SELECT doc_id, is_relevant, score, matched_topics, one_line_summary, reasoning
        FROM ({COERCED}) c WHERE NOT bad""",
    "c6_enrich_defaults": f"""SELECT doc_id, coalesce(json_extract_string(j, '$.expansion_hu'), one_line_summary) AS expansion,
        {json_list('j', 'key_dates_hu')} AS key_dates, {json_list('j', 'action_items_hu')} AS action_items FROM ({ENRICHED}) e""",
    "c7_score_request": f"""SELECT doc_id, {request('text', "CASE WHEN lang = 'fr' THEN source ELSE '' END")} AS request FROM documents""",
    "c8_enrich_request": f"""SELECT doc_id, pos, concat('Bekezdés anchor: ', anchor, chr(10), 'Relevancia score: ', {score_text('score')},
        chr(10), 'Témák: ', {topics_text('matched_topics')}, chr(10), 'Egysoros összefoglaló: ', one_line_summary, chr(10), chr(10),
        'Bekezdés szövege:', chr(10), '<<<', chr(10), {strip('text')}, chr(10), '>>>', chr(10),
        CASE WHEN pos % 2 = 0 THEN concat(chr(10), 'Indokolás:', chr(10), '<<<', chr(10), {strip('expansion')}, chr(10), '>>>', chr(10)) ELSE '' END,
        CASE WHEN justification_url IS NOT NULL THEN concat(chr(10), 'Indokolas URL: ', justification_url, chr(10)) ELSE '' END,
        {q(requests.ENRICH_SUFFIX)}) AS request FROM v_scored""",
    "c9_dedup_key": "SELECT doc_id, pos, concat(issue_number, '::', anchor) AS dedup_key FROM v_key",
    "c10_json_lists": f"""SELECT doc_id, pos, {json_text('matched_topics')} AS matched_topics,
        {json_text('action_items')} AS action_items_json, array_to_string(action_items, '|') AS read_back FROM v_scored""",
    "c12_contract_checks": """SELECT issue_id,
        count(*) FILTER (is_relevant <> (score >= 0.5)) AS bad_flag,
        count(*) FILTER (NOT is_relevant AND len(matched_topics) > 0) AS bad_topics,
        count(*) FILTER (length(one_line_summary) > 140) AS bad_summary,
        count(*) FILTER (length(expansion) > 600) AS bad_expansion,
        count(*) FILTER (len(list_filter(action_items, lambda a: length(a) > 120)) > 0) AS bad_action,
        count(*) FILTER (len(action_items) NOT BETWEEN 1 AND 3) AS bad_action_count
        FROM v_scored GROUP BY issue_id""",
    "c13_display": f"""SELECT doc_id, pos, {score_text('score')} AS score, {topics_text('matched_topics')} AS topics,
        {label_text('issue_number')} AS label, substring(one_line_summary, 1, 60) AS summary,
        {escaped("concat('<''" + '"' + "&', one_line_summary)")} AS escaped FROM v_scored""",
    "d1_no_bulletin": f"SELECT page_no, issue_number FROM ({LISTED}) e",
    "d2_window": """SELECT o_orderkey, CAST(CAST(o_orderdate AS date) AS varchar) AS order_date FROM orders
        WHERE o_orderdate BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
    "d3_long_enough": "SELECT doc_id, pos FROM v_par WHERE length(text) >= 30",
    "d4_keyword_filter": f"SELECT doc_id, pos FROM v_par WHERE {hit('text', TABLE_SCOPE.all_stems)}",
    "d5_relevant": "SELECT doc_id, pos, score FROM v_scored WHERE is_relevant AND score >= 0.5",
    "d6_failed": "SELECT doc_id, pos, error FROM v_scored WHERE error IS NOT NULL",
    "e1_unprocessed": "SELECT issue_id FROM v_issue WHERE issue_id NOT IN (SELECT issue_id FROM v_progress)",
    "e2_unreported": f"""SELECT issue_id, anchor, pos, sha256({squeeze('lower(text)')}) AS content_hash FROM v_scored s
        WHERE NOT EXISTS (SELECT 1 FROM v_reported r WHERE r.issue_number = s.issue_number AND r.anchor = s.anchor)""",
    "e3_issue_attributes": """SELECT k.issue_id, k.pos, coalesce(i.issue_number, '') AS issue_number,
        CAST(i.issue_date AS varchar) AS issue_date FROM v_key k
        LEFT JOIN (SELECT * FROM v_issue WHERE lang <> 'fr') i ON k.issue_id = i.issue_id""",
    "e4_justification": f"""SELECT p.doc_id AS issue_id, p.pos, n.text IS NOT NULL AS has_justification,
        CASE WHEN n.text IS NOT NULL THEN 'u' END AS justification_url, coalesce(n.text, '') AS justification_text
        FROM v_par p LEFT JOIN (SELECT * FROM ({sections('pages', 'page_id')}) s WHERE page_id % 3 = 1
          QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY section) = 1) n ON p.doc_id = n.page_id""",
    "e5_replies_by_id": """SELECT k.doc_id, k.pos, sha256(concat(k.issue_id, chr(31), k.anchor, chr(31), k.pos, chr(31), k.text)) AS request_id,
        r.reply FROM v_key k LEFT JOIN v_reply r ON k.doc_id = r.doc_id""",
    "e6_issue_links": """SELECT concat('szám ', CAST(floor(doc_id / 3) AS bigint)) AS issue_number, view_url AS url FROM v_issue
        QUALIFY row_number() OVER (PARTITION BY CAST(floor(doc_id / 3) AS bigint) ORDER BY issue_date, issue_id) = 1""",
    "f1_classified": "SELECT issue_id, count(*) AS items_classified FROM v_key WHERE length(text) >= 30 GROUP BY issue_id",
    "f2_relevant": "SELECT issue_id, count(*) AS items_relevant FROM v_items GROUP BY issue_id",
    "f3_funnel": f"""SELECT count(*) AS paragraphs, count(*) FILTER (kept) AS kept, count(*) FILTER (candidate) AS candidate,
        count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant AND reported) AS dropped,
        count(*) FILTER (relevant AND NOT reported) AS new
        FROM (SELECT *, candidate AND {lexical(topics('text', TABLE_SCOPE))} >= 0.5 AS relevant FROM ({FLAGS}) f) g""",
    "f4_grouped_items": f"""SELECT issue_number, CAST(issue_date AS varchar) AS issue_date, anchor, pos,
        row_number() OVER (PARTITION BY issue_number, issue_date ORDER BY anchor, pos) AS item_rank, {score_text('score')} AS score
        FROM v_items""",
    "f5_running_total": """SELECT run_id, CAST(sum(persisted) OVER (ORDER BY run_ts, run_id) AS bigint) AS running_total FROM v_runs""",
    "f6_last_run": "SELECT CAST(max(TRY_CAST(run_date_text AS date)) AS varchar) AS last_run FROM v_runs",
    "f7_issues_with_items": "SELECT DISTINCT issue_id FROM v_items",
    "g1_first_per_page": f"""SELECT page_no, issue_id, view_url FROM ({LISTED}) e
        QUALIFY row_number() OVER (PARTITION BY page_no, issue_id ORDER BY doc_id) = 1""",
    "g2_last_page_wins": f"""SELECT issue_id, page_no, issue_number, CAST(issue_date AS varchar) AS issue_date,
        justified AS has_justification, view_url, replace(view_url, '/megtekintes', '/letoltes') AS pdf_url,
        CASE WHEN justified THEN replace(view_url, '/megtekintes', '/indokolas') END AS justification_url
        FROM (SELECT * FROM ({LISTED}) e QUALIFY row_number() OVER (PARTITION BY page_no, issue_id ORDER BY doc_id) = 1) f
        WHERE issue_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY page_no DESC) = 1""",
    "g3_section_ids": f"SELECT page_id, section FROM ({sections('pages', 'page_id')}) s UNION ALL SELECT page_id, section FROM ({BODY_SECTIONS}) b",
    "g4_chunk_ordinals": "SELECT doc_id, pos + 1 AS pos FROM v_par",
    "g5_first_writer": f"SELECT issue_number, anchor, pos FROM ({FIRST_ITEMS}) f",
    "h1_newest_first": "SELECT issue_id, CAST(issue_date AS varchar) AS issue_date FROM v_issue ORDER BY issue_date DESC, issue_id DESC",
    "h2_cap": """SELECT issue_id, issue_date FROM (
        SELECT CAST(o_orderkey AS varchar) AS issue_id, CAST(CAST(o_orderdate AS date) AS varchar) AS issue_date, o_orderstatus
        FROM orders ORDER BY CAST(o_orderdate AS date) DESC, CAST(o_orderkey AS varchar) DESC LIMIT 50) t WHERE o_orderstatus <> 'F'""",
    "h3_report_order": """SELECT CAST(issue_date AS varchar) AS issue_date, issue_number, anchor, pos FROM v_items
        ORDER BY 1 DESC, 2 DESC, 3, 4""",
    "h4_reported_in_window": f"""SELECT CAST(issue_date AS varchar) AS issue_date, issue_number, anchor, score FROM ({FIRST_ITEMS}) f
        WHERE issue_date BETWEEN DATE '2024-02-01' AND DATE '2024-05-31'""",
    "h5_state_view": f"""SELECT issue_number, anchor, CAST(issue_date AS varchar) AS issue_date, {score_text('score')} AS score,
        substring(one_line_summary, 1, 60) AS summary, (SELECT CAST(sum(persisted) AS bigint) FROM v_runs) AS total_reported
        FROM (SELECT * FROM ({FIRST_ITEMS}) f ORDER BY issue_date DESC, issue_number DESC, anchor LIMIT 50) g""",
    "i1_progress_rows": """SELECT i.issue_id, CAST(i.issue_date AS varchar) AS issue_date, coalesce(c.n, 0) AS items_classified,
        coalesce(r.n, 0) AS items_relevant FROM v_issue i
        LEFT JOIN (SELECT issue_id, count(*) AS n FROM v_key WHERE length(text) >= 30 GROUP BY 1) c ON i.issue_id = c.issue_id
        LEFT JOIN (SELECT issue_id, count(*) AS n FROM v_items GROUP BY 1) r ON i.issue_id = r.issue_id""",
    "j1_insert_if_absent": f"""SELECT issue_number, anchor, pos FROM ({FIRST_ITEMS}) f
        WHERE NOT EXISTS (SELECT 1 FROM v_reported r WHERE r.issue_number = f.issue_number AND r.anchor = f.anchor)""",
    "j2_upsert": """SELECT coalesce(n.issue_id, o.issue_id) AS issue_id, coalesce(n.n, 0) AS items_relevant
        FROM v_progress o FULL JOIN (SELECT issue_id, count(*) AS n FROM v_items GROUP BY 1) n ON o.issue_id = n.issue_id""",
    "j3_run_meta": """SELECT concat('key ', new_items) AS key, CAST(arg_max(persisted, (run_ts, run_id)) AS varchar) AS value
        FROM v_runs GROUP BY 1
        UNION ALL SELECT 'last_run', CAST(max(run_date) AS varchar) FROM v_runs
        UNION ALL SELECT 'total_reported', CAST(sum(persisted) AS varchar) FROM v_runs""",
    "j5_window": """SELECT o_orderkey, CAST(CAST(o_orderdate AS date) AS varchar) AS order_date FROM orders, (
        SELECT CAST(max(o_orderdate) AS date) AS e,
               greatest(CAST(max(o_orderdate) FILTER (o_orderpriority = '1-URGENT') AS date) - 20, CAST(max(o_orderdate) AS date) - 30) AS s
        FROM orders) w WHERE o_orderdate BETWEEN s AND e""",
    "k1_lexical_scores": f"""SELECT issue_id, pos, {lexical('tags')} >= 0.5 AS is_relevant, {lexical('tags')} AS score,
        array_to_string(tags, '|') AS matched_topics, substring({squeeze('text')}, 1, 140) AS one_line_summary
        FROM (SELECT *, {topics('text', TABLE_SCOPE)} AS tags FROM ({CANDIDATES}) c) d""",
    "k1_model_scores": f"""SELECT issue_id, pos,
        CASE WHEN n % 11 = 0 THEN false WHEN n % 3 = 0 THEN NOT ({REPAIR_BROKEN}) ELSE n % 2 = 0 END AS is_relevant,
        CAST(CASE WHEN n % 11 = 0 THEN 0 WHEN n % 3 <> 0 THEN CAST(n % 100 AS double) / 100
                  WHEN {REPAIR_BROKEN} THEN 0 ELSE 0.55 END AS double) AS score,
        CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN '' ELSE concat('n', n % 4) END AS matched_topics,
        CASE WHEN n % 11 = 0 THEN 'llm_call_failed: overloaded'
             WHEN n % 3 = 0 AND {REPAIR_BROKEN} THEN 'parse_failed_after_repair' END AS error FROM ({ASKED}) a""",
    "k2_repaired": f"""SELECT issue_id, pos, NOT ({REPAIR_BROKEN}) AS is_relevant,
        CAST(CASE WHEN {REPAIR_BROKEN} THEN 0 ELSE 0.55 END AS double) AS score,
        CASE WHEN {REPAIR_BROKEN} THEN 'parse_failed_after_repair' END AS error FROM ({ASKED}) a WHERE n % 11 <> 0 AND n % 3 = 0""",
    "k3_errors": f"""SELECT error, false AS is_relevant, CAST(0 AS double) AS score, count(*) AS n FROM (
        SELECT CASE WHEN n % 11 = 0 THEN 'llm_call_failed: overloaded'
                    WHEN n % 3 = 0 AND {REPAIR_BROKEN} THEN 'parse_failed_after_repair' END AS error FROM ({ASKED}) a) b
        WHERE error IS NOT NULL GROUP BY 1""",
    "k4_lexical_enrichment": """SELECT issue_id, pos, one_line_summary AS expansion,
        concat('2024. MÁJUS 5|2024. június ', substring(CAST(pos AS varchar), 1, 2)) AS key_dates FROM v_items""",
    "k4_enriched": f"""SELECT issue_id, pos, concat(length(concat('Bekezdés anchor: ', anchor, chr(10), 'Relevancia score: ',
        {score_text('score')}, chr(10), 'Témák: ', {topics_text('matched_topics')}, chr(10), 'Egysoros összefoglaló: ', one_line_summary,
        chr(10), chr(10), 'Bekezdés szövege:', chr(10), '<<<', chr(10), {strip('text')}, chr(10), '>>>', chr(10),
        CASE WHEN justification_url IS NOT NULL THEN concat(chr(10), 'Indokolas URL: ', justification_url, chr(10)) ELSE '' END,
        {q(requests.ENRICH_SUFFIX)})), ' karakter') AS expansion, 'HR: olvasni' AS action_items FROM v_items""",
    "k6_scopes": " UNION ALL ".join(scope_rows(s) for s in (TABLE_SCOPE, STRICT_SCOPE, LATIN_SCOPE)),
    "k6_lexicon_table": rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM benchmark),
        s AS (SELECT word, length(word) AS n, {CRC} AS h FROM w),
        b AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM v_par),
        p AS (SELECT DISTINCT doc_id, pos, n, substring(t, 1, n) AS word FROM b JOIN (SELECT DISTINCT n FROM s) l ON length(t) >= n)
        SELECT doc_id, pos, concat('s', h % 50) AS scope,
          coalesce(string_agg(DISTINCT CASE WHEN h % 3 > 0 THEN substring(word, 1, 2) END, '|'
            ORDER BY CASE WHEN h % 3 > 0 THEN substring(word, 1, 2) END), '') AS topics
        FROM p JOIN s USING (word) GROUP BY doc_id, pos, h % 50""",
    "a6_report_files": f"""SELECT '2024-07-02' AS run_date, unnest(string_split(line, chr(10))) AS line
        FROM ({REPORT.replace("WHERE lang <> 'es'", "")}) r""",
    "l1_report_lines": REPORT,
    "l2_empty_reports": f"""SELECT run_id, CAST(unnest(range(len(l))) AS bigint) AS line_no, unnest(l) AS line FROM (
        SELECT run_id, list_concat([{q(report.TITLE)}, concat({q(report.FULL_TITLE)}, run_date), '',
          concat('Futtatás dátuma: ', run_date), concat('Lookback: ', run_date - 30, ' -> ', run_date),
          concat('Feldolgozott lapszámok: ', issues_scanned), concat('Új változások: ', new_items), {DOUBLE_RULE}], CASE WHEN new_items = 0 THEN
          [{q(report.NOTHING_NEW)}, concat('A figyelt időablak: ', run_date - 30, ' - ', run_date, '.')] ELSE [] END) AS l FROM v_runs
          WHERE run_id NOT IN (SELECT concat('r', lpad(CAST(doc_id AS varchar), 12, '0')) FROM v_items)) t""",
    "l3_html_fragments": HTML,
    "l4_outbox": f"""SELECT run_id, concat('[HR riport] ', run_date, ' – ', new_items, ' új változás') AS subject,
        '{MAIL.email_from}' AS sender, 'hr@example.org|payroll@example.org' AS recipients, {COVER} AS cover,
        concat('report-', run_date, '.txt|report-', run_date, '.html') AS attachments
        FROM v_runs WHERE new_items > 0""",
    "a7_state_tables": f"""SELECT concat('r', inserted) AS run_id, concat(issue_number, '::', anchor) AS dedup_key,
        sha256({squeeze('lower(text)')}) AS content_hash, score, array_to_string(key_dates, '|') AS key_dates,
        array_to_string(action_items, '|') AS action_items, '2024-07-02 08:00:00' AS reported_at,
        (SELECT count(*) FROM (SELECT DISTINCT issue_number, anchor FROM v_items) k) AS total_reported
        FROM ({STATE_ITEMS}) s WHERE inserted = 2 OR round = 1
        QUALIFY row_number() OVER (PARTITION BY issue_number, anchor ORDER BY issue_id, pos) = 1""",
    "j4_reset": "SELECT 0 AS reported, 0 AS progress, 0 AS runs, count(*) AS written FROM v_items WHERE score >= 0.75",
    "j5_open_issues": """SELECT concat('2024/', n) AS issue_id, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'no content' END AS reason
        FROM (SELECT DISTINCT doc_id % 3000 + 1 AS n FROM documents) t WHERE n % 5 IN (0, 1) AND n % 3 <> 0""",
    "l5_run_row": f"""SELECT 'r1' AS run_id, '2023-10-01' AS window_start, * EXCLUDE (scope), CAST(0 AS bigint) AS warnings
        FROM ({run_row(TABLE_SCOPE)}) r""",
    "a8_dry_run": f"""SELECT issues_scanned, candidates, relevant, new_items, CAST(0 AS bigint) AS persisted, '' AS report_path,
        CAST(0 AS bigint) AS written FROM ({run_row(TABLE_SCOPE)}) r""",
    "k6_run_scopes": " UNION ALL ".join(
        f"SELECT 'r1-{s.name}' AS run_id, * EXCLUDE (paragraphs) FROM ({run_row(s)}) r" for s in (TABLE_SCOPE, STRICT_SCOPE)),
    "m1_arrivals": f"""SELECT issue_number, anchor, sha256({squeeze('lower(text)')}) AS content_hash,
        {lexical('tags')} AS score, array_to_string(tags, '|') AS matched_topics
        FROM (SELECT concat('2024. évi ', page_id, '. szám') AS issue_number, section, {paragraph_anchor('heading')} AS anchor, text,
            {topics('text', TABLE_SCOPE)} AS tags FROM ({sections('pages', 'page_id')}) s
          WHERE length(text) >= 30 AND {hit('text', TABLE_SCOPE.all_stems)}) t
        WHERE {lexical('tags')} >= 0.5
        QUALIFY row_number() OVER (PARTITION BY issue_number, anchor ORDER BY section) = 1""",
    "m1_retries": f"""SELECT issue_number, anchor, sha256({squeeze('lower(text)')}) AS content_hash,
        CAST(0.9 AS double) AS score, CAST(0 AS bigint) AS left_open
        FROM (SELECT concat('2024. évi ', page_id, '. szám') AS issue_number, section, {paragraph_anchor('heading')} AS anchor, text
          FROM ({sections('pages', 'page_id')}) s
          WHERE length(text) >= 30 AND {hit('text', TABLE_SCOPE.all_stems)}) t
        QUALIFY row_number() OVER (PARTITION BY issue_number, anchor ORDER BY section) = 1""",
    "m2_recent_stream": "SELECT DISTINCT user_id, event_type FROM events",
    "m2_recent_batch": """SELECT event_id, user_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "topic_counts": f"""SELECT topic, lang, count(*) AS paragraphs, count(DISTINCT h) AS texts FROM (
        SELECT lang, unnest({topics('text', TABLE_SCOPE)}) AS topic, sha256({squeeze('lower(text)')}) AS h
        FROM v_par WHERE length(text) >= 30) t GROUP BY 1, 2""",
}

# Folding the state changes nothing in it.
TWINS["a7_compacted_state"] = TWINS["a7_state_tables"]


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in TWINS.items()}
