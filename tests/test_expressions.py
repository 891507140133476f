"""Column expressions against hand-written cases and plain Python."""

import hashlib
import html as html_lib
import json
import re
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawtide.functions import lexicon, replies, requests, text, urls
from lawtide.functions.anchors import inferred_anchor, paragraph_anchor
from lawtide.functions.dates import local_date, published_date


def apply(spark, values, *expressions):
    """Results of expressions over a one-column table, in input order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    out = rows.select("i", *[e(F.col("v")).alias(f"c{n}") for n, e in enumerate(expressions)])
    found = [tuple(r)[1:] for r in sorted(out.collect())]
    return [r[0] for r in found] if len(expressions) == 1 else found


def test_local_dates(spark):
    cases = {
        "2026. július 1.": date(2026, 7, 1),
        "Kelt: 2026. DECEMBER 31": date(2026, 12, 31),
        "2026. decemebr 3.": date(2026, 12, 3),
        "2026. február 30.": None,
        "2024. február 29. és 2025. március 1.": date(2024, 2, 29),
        "2026. április5": date(2026, 4, 5),
        "2026. brumaire 3.": None,
        "": None,
    }
    assert apply(spark, list(cases), local_date) == list(cases.values())


def test_published_date_prefers_meta(spark):
    cases = {
        '<meta content="2026-07-01" itemprop="datePublished"/>2025. május 2.': date(2026, 7, 1),
        "<meta itemprop='datePublished' content='2026-07-01'>": date(2026, 7, 1),
        '<meta itemprop="url" content="2026-07-01"> 2025. május 2.': date(2025, 5, 2),
        '<meta itemprop="datePublished" content="soon"> 2025. május 2.': date(2025, 5, 2),
        "no date": None,
    }
    assert apply(spark, list(cases), lambda v: published_date(v, text.node_text(v))) == list(cases.values())


def test_anchors(spark):
    cases = {
        "12. § (3)": "12. §", "12.§": "12. §", "IV. fejezet": "IV. fejezet", "XIV. cím (2)": "XIV. fejezet",
        "(5) bekezdés": "(5)", "(0)": None, "(100)": None, "1234. §": "234. §", "xIV. cím": None,
        "II. fejezetek (7)": "(7)", "§II. rész": "II. fejezet", "(II. rész 3. §": "II. fejezet",
        "Semmi": None, "": None,
    }
    assert apply(spark, list(cases), inferred_anchor) == list(cases.values())
    long = "Egy negyven karakternél hosszabb fejléc, jel nélkül"
    assert apply(spark, [long, "", "12. §"], paragraph_anchor) == [long[:40], "ismeretlen", "12. §"]


def test_urls(spark):
    base = "https://site.example/base"
    cases = {
        "/hivatalos-lapok/ab/dokumentumok/x/megtekintes": "https://site.example/dokumentumok/x/megtekintes",
        "/dokumentumok/x/megtekintes": "https://site.example/dokumentumok/x/megtekintes",
        "../dokumentumok/x/megtekintes": "https://site.example/dokumentumok/x/megtekintes",
        "hu/dokumentumok/x/megtekintes": "https://site.example/hu/dokumentumok/x/megtekintes",
        "//cdn.example/dokumentumok/x/megtekintes": "https://cdn.example/dokumentumok/x/megtekintes",
        "http://a.example/dokumentumok/x/megtekintes": "http://a.example/dokumentumok/x/megtekintes",
    }
    assert apply(spark, list(cases), lambda v: urls.absolute_url(v, base)) == list(cases.values())
    view = "https://s/dokumentumok/x/megtekintes"
    assert apply(spark, [view], urls.download_url, lambda v: urls.justification_url(v, F.lit(True)),
                 lambda v: urls.justification_url(v, F.lit(False))) == [
        ("https://s/dokumentumok/x/letoltes", "https://s/dokumentumok/x/indokolas", None)]


def test_justification_links(spark):
    cases = {
        '<a href="/indoklasok/1">x</a>': True, "<a href='/INDOKLASOK'>x</a>": True,
        '<a href="/x"> »Indokolások</a>': False, '<a href="/x">indoklás</a>': True,
        '<a href="/x"><img alt="indokl"></a>': False, "indoklas": False,
    }
    assert apply(spark, list(cases), urls.has_justification_link) == list(cases.values())


def test_hash_ignores_case_and_white_space(spark):
    values = ["Hello   World\n\nFoo", " hello world foo ", "árvíz TŰRŐ"]
    expected = [hashlib.sha256(re.sub(r"\s+", " ", v.lower()).strip().encode()).hexdigest() for v in values]
    assert apply(spark, values, text.content_hash) == expected
    assert expected[0] == expected[1]


def test_white_space_is_pythons(spark):
    blank = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert set(text.WHITESPACE) == set(blank)
    assert apply(spark, [f"{c}a{c}b{c}" for c in blank], text.strip, text.squeeze) == [
        (f"a{c}b", "a b") for c in blank]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("aő&#;xX0123456789lt gamp<>\n"), max_size=30), min_size=60, max_size=60))
def test_entities_are_decoded_once(spark, values):
    values = values + ["&amp;lt;", "&#38;lt;", "&odblac;", "&#x151;&#337;", "&nbsp;", "&bogus;", "&#xD800;", "&", "a&b;"]
    values += [f"&{n}x" for n in list(html_lib.entities.html5)[::17]] + ["&#0000000233;", "&para; &frac12 &Aring;&sect1", "&#128;&#0;&#x1;&#9999999999;"]
    assert apply(spark, values, text.decode_entities) == [html_lib.unescape(v) for v in values]



def test_node_text(spark):
    cases = {
        "<p>A &lt;b <b>bold</b> te<br>xt a < b</p>": "A <b bold te xt a < b",
        "<p> \n </p>": "", "plain": "plain", "<!-- x --><i>y</i>": "y", "a<b>c</b>": "a c",
    }
    assert apply(spark, list(cases), text.node_text) == list(cases.values())


def test_html_to_text(spark):
    page = ("<style>p{}</style><h1>Cím</h1><p>a &amp;lt; b&nbsp;&nbsp;c</p><br/>\n\n\n<script>var t='</p>';</script>"
            "<ul><li>x &middot; y</li></ul>&sect; &ge; &ndash; &rarr;")
    assert apply(spark, [page], text.html_to_text) == ["Cím\na < b c\n\nx · y\n§ >= - ->"]


def test_bytes_by_charset(spark):
    rows = [
        (0, "árvíztűrő".encode("iso-8859-2"), "ISO-8859-2"), (1, "ő".encode("iso-8859-2"), "latin-2"),
        (2, "árvíztűrő".encode(), "UTF-8"), (3, b"a\xffb", "utf-8"), (4, "áb".encode("latin-1"), None),
        (5, "ő€".encode("cp1250"), "windows-1250"), (6, "ű".encode("utf-16-le"), "UTF-16LE"),
    ]
    df = spark.createDataFrame(rows, "i int, b binary, c string")
    got = [r.t for r in df.select("i", text.decode_bytes(F.col("b"), F.col("c")).alias("t")).orderBy("i").collect()]
    assert got == ["árvíztűrő", "ő", "árvíztűrő", "a�b", "áb", "ő€", "ű"]
    sent = spark.range(1).select(text.encode_single_byte(F.lit("őáñ漢"), "iso-8859-2").alias("b")).first().b
    assert bytes(sent) == "őá??".encode("iso-8859-2")


def test_display_formats(spark):
    scores = spark.createDataFrame([(x,) for x in (0.825, 0.5, 1.0, 0.005)], "s double")
    assert [r[0] for r in scores.select(text.score_text(F.col("s"))).collect()] == [
        f"{x:.2f}" for x in (0.825, 0.5, 1.0, 0.005)]
    topics = spark.createDataFrame([(["bér", "szja", "cafeteria"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in topics.select(text.topics_text(F.col("t"))).collect()] == [
        "bér, szja, cafeteria", "(nincs)", "(nincs)"]
    assert apply(spark, ["2026. évi 83. szám", "Magyar Közlöny 1. szám"], text.label_text) == [
        "Magyar Közlöny 2026. évi 83. szám", "Magyar Közlöny 1. szám"]


def test_lists_as_json(spark):
    lists = [["bér", "a\"b", "x\\y", "[z]"], [], ["sor\ntörés"], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, l array<string>")
    out = df.select("i", text.list_to_json(F.col("l")).alias("j")).withColumn("b", text.json_to_list(F.col("j")))
    got = out.orderBy("i").collect()
    assert [r.j for r in got] == [json.dumps(x or [], ensure_ascii=False) for x in lists]
    assert [r.b for r in got] == [x or [] for x in lists]


# -- lexicon -------------------------------------------------------------------

SENTENCES = [
    "Tegnap egy munkavállaló szabadságot kért az üzemben.",
    "A MUNKAVÁLLALÓK napja ősszel lesz.", "Több lett a nyugdíjak összege.",
    "A hídon lejárt az autók engedélye.", "", "éhrx", "hr", "_hr", "ahr", "7hr", "-hr-",
    "önkéntes nyugdíjpénztári befizetés", "önkéntes munkát végez", "munkavédelmi szabályzat",
    "éjszakai munka és home office", "home-office", "A 4 napos munkahét", "14 napos munkahét",
    "minimálbér, bérminimum", "üzemi tanács", "szemüzemi tanács", "x́hr", "sztrájk\nhr",
]


def python_hits(stems, sentence):
    return bool(re.search(r"\b(?:" + "|".join(stems) + ")", sentence.lower()))


def test_keywords_like_python(spark):
    expected = [python_hits(lexicon.HR_SCOPE.all_stems, s) for s in SENTENCES]
    assert True in expected and False in expected
    hit = lambda v: lexicon.keyword_hit(lexicon.searched_text(v))
    assert apply(spark, SENTENCES, hit) == expected


def test_context_counts(spark):
    df = spark.createDataFrame([("Ma este esni fog az eső.", "Ez a munkavállalókról szól.")], "t string, c string")
    assert df.select(lexicon.keyword_hit(lexicon.searched_text(F.col("t"), F.col("c")))).first()[0]
    assert not df.select(lexicon.keyword_hit(lexicon.searched_text(F.col("t")))).first()[0]


def tags(v, scope=lexicon.HR_SCOPE, scopes=None):
    scopes = scopes or [scope]
    return lexicon.tags_of(lexicon.found_stems(lexicon.searched_text(v), scopes), scope, scopes)


def test_one_pass_topics_equal_one_search_per_topic(spark):
    expected = [
        sorted(t for t, stems in lexicon.HR_SCOPE.topics.items() if python_hits(stems, s))
        if python_hits(lexicon.HR_SCOPE.all_stems, s) else None for s in SENTENCES]
    slow = lambda v: lexicon.tags_by_pattern(lexicon.searched_text(v), lexicon.HR_SCOPE)
    other = lexicon.Scope("other", {"t": ("munkavállalóképzés", "napos")})
    both = lambda v: tags(v, scopes=[other, lexicon.HR_SCOPE])
    assert apply(spark, SENTENCES, tags, slow, both) == [(e, e, e) for e in expected]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.lists(st.text("ab -", min_size=1, max_size=4), min_size=1, max_size=4), min_size=1, max_size=3),
    st.lists(st.text("ab -c", max_size=14), min_size=40, max_size=40))
def test_shared_prefixes_like_plain_alternation(spark, topics, texts):
    # A stem starts with a letter, as a word does.
    groups = {f"t{i}": tuple("a" + s for s in stems) for i, stems in enumerate(topics)}
    scope = lexicon.Scope("s", groups)
    expected = []
    for sentence in texts:
        hit = [t for t, stems in groups.items() if python_hits([re.escape(s) for s in stems], sentence)]
        expected.append((sorted(hit) or None, bool(hit)))
    hit = lambda v: lexicon.keyword_hit(lexicon.searched_text(v), scope)
    assert apply(spark, texts, lambda v: tags(v, scope), hit) == expected


def test_lexicon_has_all_stems():
    assert len(lexicon.HR_SCOPE.all_stems) == 127 and len(lexicon.HR_SCOPE.topics) == 14
    assert lexicon.plain_stems("önkéntes (pénztár|nyugdíjpénztár)") == ["önkéntes pénztár", "önkéntes nyugdíjpénztár"]
    assert lexicon.plain_stems("mun[ck]a") is None


def test_scopes_from_table(spark):
    rows = [("tax", "vat", "áfa|forgalmi adó"), ("tax", None, "adó"), ("hr", "pay", "bér")]
    scopes = lexicon.scopes_from_table(
        spark.createDataFrame(rows, "scope string, topic string, pattern string"), {"tax": 0.7})
    by_name = {s.name: s for s in scopes}
    assert by_name["tax"].threshold == 0.7 and by_name["tax"].generic == ("adó",)
    assert apply(spark, ["Az áfa és az adók", "adózás", "semmi"], lambda v: tags(v, by_name["tax"])) == [["vat"], [], None]


# -- replies -------------------------------------------------------------------

CLEAN = '{"is_relevant": true, "score": 0.7, "matched_topics": ["bér", "szja"], "one_line_summary_hu": "x", "reasoning_hu": "y"}'
READ = json.loads(CLEAN)
REPLIES = {
    CLEAN: READ, f"```json\n{CLEAN}\n```": READ, f"```\n{CLEAN}```": READ, f"Here: {CLEAN} done": READ, f" {CLEAN}\n": READ,
    "{}": {}, '{"one_line_summary_hu": "Az "adó" szóról."}': None, '{"a": "x\ny"}': None, "[1, 2]": None,
    f"[{CLEAN}]": None, "12": None, "null": None, "": None, "no json": None, "{'a': 1}": None,
    '{"a": 1} {"b": 2}': None, '{"a": 1}, {"b": 2}': None, "{": None,
}


def test_strict_replies(spark):
    got = apply(spark, list(REPLIES), lambda v: F.to_json(replies.reply_object(v)))
    assert [None if g is None else json.loads(g) for g in got] == list(REPLIES.values())


def test_strictness_deviations(spark):
    # Python's json takes these two; here they are failures and go to the repair pass.
    assert apply(spark, ['{"score": NaN}', '{"a": 1, "a": 2}'], lambda v: replies.reply_object(v).isNull()) == [True, True]


def scored(v):
    return F.struct(*[c.alias(n) for n, c in replies.score_fields(replies.reply_object(v)).items()])


def test_score_defaults(spark):
    cases = {
        '{"score": 1.7, "is_relevant": true}': (True, 1.0), "{}": (False, 0.0), '{"score": -2}': (False, 0.0),
        '{"score": " 0.8 "}': (False, 0.8), '{"score": "0.8d"}': (False, 0.0), '{"score": "1e-1"}': (False, 0.1),
        '{"score": null}': (False, 0.0), '{"score": [1]}': (False, 0.0), '{"score": true}': (False, 1.0),
        '{"score": "nan"}': (False, 1.0), '{"score": "inf"}': (False, 1.0), '{"is_relevant": "no"}': (True, 0.0),
        '{"is_relevant": ""}': (False, 0.0), '{"is_relevant": 0}': (False, 0.0), '{"is_relevant": [0]}': (True, 0.0),
        '{"is_relevant": {}}': (False, 0.0), '{"is_relevant": null}': (False, 0.0),
    }
    assert [(r.is_relevant, r.score) for r in apply(spark, list(cases), scored)] == list(cases.values())
    empty = apply(spark, ["{}"], scored)[0]
    assert (empty.matched_topics, empty.one_line_summary, empty.reasoning) == ([], "", "")


def test_enrich_defaults(spark):
    fields = lambda v: F.struct(*[
        c.alias(n) for n, c in replies.enrich_fields(replies.reply_object(v), F.lit("FB")).items()])
    cases = {
        '{"expansion_hu": "x", "key_dates_hu": "oops", "action_items_hu": 42}': ("x", [], []),
        '{"key_dates_hu": ["2026.01.01."], "action_items_hu": ["x"]}': ("FB", ["2026.01.01."], ["x"]),
        "broken": ("FB", [], []),
    }
    assert [tuple(r) for r in apply(spark, list(cases), fields)] == list(cases.values())


def test_requests(spark):
    df = spark.createDataFrame([("  szöveg\n", " ok ", "12. §", 0.825, ["a", "b"], "röv", "u")],
                               "t string, c string, a string, s double, m array<string>, o string, u string")
    c = F.col
    first = df.select(
        requests.score_request(c("t"), c("c")), requests.score_request(c("t"), F.lit(" \n")),
        requests.enrich_request(c("a"), c("s"), c("m"), c("o"), c("t"), F.lit(""), c("u")),
        requests.repair_request(c("t"), "score")).first()
    assert first[0] == ("Bekezdés szövege:\n<<<\nszöveg\n>>>\n\nIndokolás (kontextus):\n<<<\nok\n>>>" + requests.SCORE_SUFFIX)
    assert first[1] == "Bekezdés szövege:\n<<<\nszöveg\n>>>" + requests.SCORE_SUFFIX
    assert first[2] == ("Bekezdés anchor: 12. §\nRelevancia score: 0.82\nTémák: a, b\nEgysoros összefoglaló: röv\n\n"
                        "Bekezdés szövege:\n<<<\nszöveg\n>>>\n\nIndokolas URL: u\n" + requests.ENRICH_SUFFIX)
    assert first[3] == requests.REPAIR["score"] + "  szöveg\n"


@pytest.mark.parametrize("bad", [{"lookback_days": 0}, {"relevance_threshold": 1.1}, {"max_issues_per_run": 0},
                                 {"min_paragraph_length": 9}, {"scoring_concurrency": 0}, {"dedup_key": "x"}])
def test_config_ranges(bad):
    from lawtide import MonitorConfig
    with pytest.raises(ValueError):
        MonitorConfig(**bad)
