"""Operators of lawtide.llm against brute force, round trips and held-out accuracy, edge cases included."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lawtide.llm import (
    backoff, chat, exact, language, line_chunks, minhash, mixing, page_text, phrase_index, queries, sql, substrings)
from lawtide.llm.components import components
from lawtide.sources.workspace import Stage
from oracle import connect, difference

SF = "/root/testdata/sf0.001"
# "id", "row", "node", ... are names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, row int, hash long, bundle long"
WORDS = [f"w{i}" for i in range(400)]


def made_docs(seed=0, n=60):
    """Prose of random words with near copies, shared passages, copies, nulls and odd texts."""
    rng = random.Random(seed)
    texts = []
    passage = [rng.choice(WORDS) for _ in range(60)]
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.35:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        else:
            words = [rng.choice(WORDS) for _ in range(rng.randint(1, 120))]
            if kind > 0.8:
                cut = rng.randint(0, 30)
                words += passage[cut: cut + 25] + [rng.choice(WORDS) for _ in range(8)]
            texts.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in words))
    texts += [None, "", "  \n\t ", "one", "ONE", "one two", "a a a a a a a a a a a a a a a a a a a a", "Übung – ñ x"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(20000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None]), len(t or ""), f"x{i}", 7, 1, 2, 3)
            for i, t in zip(ids, texts)]
    return rows + [rows[3], rows[-2], (rows[5][0], "another text for a repeated id here", *rows[5][2:]),
                   (None, rows[2][1], *rows[2][2:])]


@pytest.fixture(scope="module")
def rows():
    return made_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_against_sql(spark, name):
    con = connect(SF)
    assert difference(spark, con, SF, queries.QUERIES[name], sql.ORACLES.get(name)) is None


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), Stage(spark), "c")
    same(got, [(x, find(x)) for x in root])


def test_components_read_links_once(spark):
    """A crowd behind many small hubs, and a chain: what is connected is not read in the next round, nor kept."""
    class Links(Stage):
        def __call__(self, df, name, *args, **options):
            out = super().__call__(df, name, *args, **options)
            if "_links" in name:
                rows.append(out.count())
            return out

    rows, crowd = [], range(100, 400)
    edges = sorted({(min(x, x ^ bit), max(x, x ^ bit)) for x in crowd for bit in map((1).__lshift__, range(9)) if x ^ bit in crowd})
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    stage = Links(spark)
    got = components(spark.createDataFrame(edges + edges, "a long, b long"), stage, "c")
    same(got, [(x, 100) for x in crowd] + [(x, 1000) for x in range(1000, 1201)] + [(7, 7)])
    assert rows[0] == len(edges) and sum(rows) < 1.5 * len(edges) and len(rows) < 6, rows
    assert len(os.listdir(stage.root)) <= len(rows)


def test_near_duplicates_keep_two_tables(spark):
    rows = list(enumerate(templates(random.Random(4), 2, 20, changed=16, edits=3)))
    stage = Stage(spark)
    stage(spark.range(3), "own")
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), stage)
    assert sorted(os.listdir(stage.root)) == ["named", "own", "signed"]
    same(got, near_expected(rows, 5, 80))


def near_expected(rows, n, percent):
    sets = defaultdict(list)
    for i, text, *_ in rows:
        words = split(text, lower=True)
        sets[frozenset(tuple(words[j: j + n]) for j in range(max(1, len(words) - n + 1))) if words else None].append(i)
    nodes = [s for s in sets if s is not None]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, one in enumerate(nodes):
        for b in range(a):
            both = len(one & nodes[b])
            if 100 * both >= percent * (len(one) + len(nodes[b]) - both):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for a, one in enumerate(nodes):
        low[find(a)] += [i for i in sets[one] if i is not None]
    out = [(i, 0, i, True) for i in sets[None]]
    for a, one in enumerate(nodes):
        name = min(low[find(a)], default=None)
        out += [(i, len(one), name, i == name) for i in sets[one]]
    return out


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, docs, rows, n, percent):
    got = minhash.near_duplicates(docs, Stage(spark), shingle=n, percent=percent, bands=64 if percent > 60 else 160,
                                  rows=6 if percent > 60 else 2)
    same(got, near_expected(rows, n, percent))


def test_near_duplicates_of_a_large_family(spark):
    """Many edits of one text: most pairs are near the threshold, and few go through the centre."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(90)] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Stage(spark), shingle=3, percent=85)
    same(got, near_expected(rows, 3, 85))


def templates(rng, n_templates, copies, n_words=220, changed=16, edits=2):
    """Texts around templates that differ from the first one in spread words, and edits of each."""
    first = [f"t{i}" for i in range(n_words)]
    texts = []
    for t in range(n_templates):
        base = list(first)
        for i in rng.sample(range(n_words), changed if t else 0):
            base[i] = f"c{t}x{i}"
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(1, edits)):
                words[rng.randrange(n_words)] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(words))
    return texts


class Rows(Stage):
    """Counts the rows of each table that holds candidate pairs or places of the prefix filter."""

    def __call__(self, df, name, *args, **options):
        out = super().__call__(df, name, *args, **options)
        self.counts = getattr(self, "counts", {})
        if name.endswith("pairs"):
            self.counts[name] = self.counts.get(name, 0) + out.count()
        return out


@pytest.mark.parametrize("n, changed, edits", [(2, 16, 2), (5, 14, 3), (3, 9, 4)])
def test_near_duplicates_of_several_clusters(spark, n, changed, edits):
    """Clusters of near copies in one family: links as by brute force, and candidates in proportion to rows."""
    rows = list(enumerate(templates(random.Random(n), n, 60, changed=changed, edits=edits)))
    stage = Rows(spark)
    got = minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), stage, shingle=5, percent=80)
    same(got, near_expected(rows, 5, 80))
    assert sum(stage.counts.values()) <= 3 * len(rows), stage.counts


def test_near_duplicates_without_ids(spark):
    """Rows that share an id or have none: each text is read once for its node."""
    texts = templates(random.Random(1), 1, 1) + [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(60)] * 2
    rows = [(None if i % 2 else 7, t + (" more" if i > 60 else "")) for i, t in enumerate(texts)]

    plans = []

    class Sets(Stage):
        def __call__(self, df, name, *args, **options):
            if name == "sets":
                plans.append(df._jdf.queryExecution().toString())
            return super().__call__(df, name, *args, **options)

    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Sets(spark), shingle=5, percent=80)
    same(got, near_expected(rows, 5, 80))
    assert re.search(r"SortMergeJoin \[coalesce\(id[^\n]*key#", plans[0])


def test_near_duplicates_of_nothing(spark, nothing):
    assert minhash.near_duplicates(nothing, Stage(spark)).count() == 0


def contaminated(rows, items, window=10):
    out = []
    for i, text, *_ in rows:
        words, hit, found = lettered(text), set(), set()
        for item, passage in items:
            own = lettered(passage)
            n = min(window, len(own))
            phrases = {tuple(own[j: j + n]) for j in range(len(own) - n + 1)} if n else set()
            for j in range(len(words) - n + 1 if n else 0):
                if tuple(words[j: j + n]) in phrases:
                    hit.update(range(j, j + n))
                    found.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), tuple(sorted(found)), bool(hit)))
    return out


def made_items(rows):
    texts = [t for _, t, *_ in rows if t and len(split(t)) > 30]
    return [(1, " ".join(split(texts[0])[3:20])), (10, " ".join(split(texts[1])[:10]).upper() + "!"), (2, "one two"),
            (3, None), (4, ""), (5, "zz"), (None, " ".join(split(texts[2])[5:17])), (1, " ".join(split(texts[0])[3:20])),
            (6, "a a a a a a a a a a a a")]


@pytest.mark.parametrize("blocks, shard", [(1 << 24, 1 << 20), (40, 50)])
def test_contamination(spark, docs, rows, monkeypatch, blocks, shard):
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(phrase_index, "SHARD_WORDS", shard)
    items = made_items(rows)
    got = phrase_index.contamination(docs, spark.createDataFrame(items, "item_id int, text string"), Stage(spark))
    same(got.select("doc_id", "n_words", "n_hit", "items", "contaminated").rdd.map(lambda r: (*r[:3], tuple(r[3]), r[4])),
         contaminated(rows, items))


def test_contamination_of_nothing(spark, docs, rows, nothing):
    items = spark.createDataFrame([], "item_id int, text string")
    assert phrase_index.contamination(docs, items, Stage(spark)).where("n_hit > 0").count() == 0
    assert phrase_index.contamination(nothing, items, Stage(spark)).count() == 0


def test_proximity(spark):
    rng = random.Random(3)
    texts = [[rng.choice("abcdefg") for _ in range(80)] for _ in range(12)]
    index = phrase_index.build_index(
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1),
        Stage(spark), shard_words=200)
    got = phrase_index.proximity_matches(
        index, spark.createDataFrame([(1, "a b b c g"), (2, "a z")], "item_id long, text string"), within=6)
    docs = phrase_index.indexed_documents(index).select("shard", "place", "id")
    inside = defaultdict(set)
    for r in got.join(docs, ["shard", "place"]).collect():
        assert r["item_id"] == 1
        inside[r["id"]].update(range(r["first_word"], r["end_word"]))
    for i, text in enumerate(texts):
        expected = set()
        for a in range(len(text)):
            for b in range(a + 1, min(a + 6, len(text)) + 1):
                if set(text[a:b]) >= set("abcg") and set(text[a + 1: b]) < set(text[a:b]) | {0}:
                    if not set(text[a + 1: b]) >= set("abcg") or text[a] in "abcg":
                        if not set(text[a: b - 1]) >= set("abcg") and text[a] in "abcg":
                            expected.update(range(a, b))
                            break
        assert inside[i] == expected, i


def passages(rows, n):
    def grams(text, size):
        words = split(text)
        return [tuple(words[j: j + size]) for j in range(len(words) - size + 1)]

    owners, size = {}, n
    while True:
        owners[size] = defaultdict(set)
        for i, text, *_ in rows:
            for key in grams(text, size):
                owners[size][key].add(math.inf if i is None else i)
        if not owners[size]:
            break
        size *= 2
    out = []
    for i, text, *_ in rows:
        own = math.inf if i is None else i
        words, gone, longest = split(text), set(), 0
        for j, key in enumerate(grams(text, n)):
            if min(owners[n][key]) < own:
                gone.update(range(j, j + n))
        for size, table in owners.items():
            if any(table[key] - {own} for key in grams(text, size)):
                longest = size
        out.append((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone), longest))
    return out


@pytest.mark.parametrize("words", [1, 2, 5, 6, 13])
def test_substrings_of_any_length(spark, words):
    """Odd and even lengths: what is removed comes out of the windows of half the length."""
    rows = [r for r in made_docs(4, 16) if len(r[1] or "") < 3000]
    got = substrings.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3), Stage(spark), words=words, longest=False)
    same(got.select("doc_id", "n_words", "n_removed", "kept"), [r[:4] for r in passages(rows, words)])
    assert "longest" not in got.columns


@pytest.mark.parametrize("bundle, part", [(3 << 20, 2 << 20), (2000, 300)])
def test_substrings(spark, monkeypatch, bundle, part):
    import lawtide.llm.bundles as bundles

    monkeypatch.setattr(bundles, "BUNDLE_BYTES", bundle)
    monkeypatch.setattr(bundles, "PART_KEYS", part)
    rows = [r for r in made_docs(2, 24) if len(r[1] or "") < 9000]
    got = substrings.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3), Stage(spark), words=5)
    same(got.select("doc_id", "n_words", "n_removed", "kept", "longest"), passages(rows, 5))
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


@pytest.mark.parametrize("part, one_step", [(60, 1), (150, 0)])
def test_keys_exchanged_in_two_steps(spark, monkeypatch, part, one_step):
    """Crews of bundles get the answers that bundles would get alone, whatever the number of parts."""
    import lawtide.llm.bundles as bundles

    monkeypatch.setattr(bundles, "PART_KEYS", part)
    rows = [r for r in made_docs(5, 24) if len(r[1] or "") < 5000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(12)
    plain = [x.collect() for x in (substrings.repeated_passages(docs, Stage(spark), words=5), backoff.backoff_scores(docs, Stage(spark)))]
    monkeypatch.setattr(bundles, "ONE_STEP", one_step)
    text = "".join(r[1] or "" for r in rows)
    bits = bundles.part_bits(len(text) // 6)
    assert bundles.first_bits(bits) < bits
    crewed = [x.collect() for x in (substrings.repeated_passages(docs, Stage(spark), words=5), backoff.backoff_scores(docs, Stage(spark)))]
    for a, b in zip(plain, crewed):
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_substrings_of_nothing(spark, nothing):
    assert substrings.repeated_passages(nothing, Stage(spark)).count() == 0


def backed_off(rows, order=3, alpha=0.4):
    texts = [split(t, lower=True) for _, t, *_ in rows]
    own = [[Counter(tuple(t[i: i + n]) for i in range(len(t) - n + 1)) for n in range(1, order + 1)] for t in texts]
    all_ = [sum((o[n] for o in own), Counter()) for n in range(order)]
    total = sum(map(len, texts))
    out = []
    for (i, *_), t, mine in zip(rows, texts, own):
        def count(gram):
            return all_[len(gram) - 1][gram] - mine[len(gram) - 1][gram]
        score = 0
        for j in range(len(t)):
            most = min(order, j + 1)
            for n in range(most, 0, -1):
                gram = tuple(t[j - n + 1: j + 1])
                if n == 1:
                    s = max(count(gram), 0.5) / max(total - len(t), 1)
                elif count(gram) > 0:
                    s = count(gram) / count(gram[:-1])
                else:
                    continue
                score += round(math.log(s * alpha ** (most - n)) * 1e6)
                break
        out.append((i, len(t), score / 1e6))
    return out


@pytest.mark.parametrize("form", [backoff.backoff_scores, backoff.relational_scores])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, docs, rows, order, form):
    got = form(docs, Stage(spark), order=order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    expected = sorted(backed_off(rows, order), key=key)
    for g, e in zip(sorted(got, key=key), expected, strict=True):
        assert g[:2] == e[:2] and abs(g[2] - e[2]) < 1e-4 * max(1, e[1])
        assert (g["mean_logprob"] is None) == (e[1] == 0)


def test_backoff_of_nothing(spark, nothing):
    assert backoff.backoff_scores(nothing, Stage(spark)).count() == 0
    assert backoff.relational_scores(nothing, Stage(spark)).count() == 0


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact(spark, digest_all, rows):
    rows = rows + [(900, "x  y", *rows[0][2:]), (901, "x\ny", *rows[0][2:]), (902, "x" * 300 + "a", *rows[0][2:]),
                   (903, "x" * 300 + "b", *rows[0][2:])]
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    expected = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    got = exact.exact_groups(spark.createDataFrame(rows, SCHEMA), Stage(spark), digest_all=digest_all)
    if digest_all:
        same(got, expected)
    else:
        same(got.drop("text_sha256"), [e[:4] for e in expected])
        told = {(e[0], e[4]) for e in expected}
        for r in got.collect():
            assert r["text_sha256"] is None and r["group_size"] == 1 or (r["doc_id"], r["text_sha256"]) in told


def test_exact_of_nothing(spark, nothing):
    assert exact.exact_groups(nothing, Stage(spark)).count() == 0


def test_exact_stays_native(spark, docs):
    plan = exact.exact_groups(docs, Stage(spark), digest_all=True)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def line_rows():
    rng = random.Random(9)
    block = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(12)]
    out = []
    for i in range(30):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = block
        if i % 7 == 0:
            lines.insert(1, "")
        out.append((i, "\n".join(lines)))
    return out + [(40, None), (41, ""), (42, "\n\n\n"), (43, "single"), (44, "single"), (45, out[4][1]), (4, out[4][1]), (None, out[6][1])]


def lines_left(rows, reach=1):
    """Chunks from the operator's boundaries; everything after that in plain Python."""
    import numpy as np
    import pyarrow as pa

    from lawtide.llm.words import words_of

    chunks, first = [], {}
    for i, text in rows:
        lines = words_of(pa.array([text], pa.string()), np.arange(256) != 10, lower=False)
        edges = line_chunks.chunk_edges(lines.hashes(), lines.first, reach).tolist()
        raw = (text or "").encode()
        own = []
        for a, b in zip(edges, edges[1:]):
            begin = 0 if a == 0 else int(lines.start[a])
            after = len(raw) if b == len(lines.start) else int(lines.start[b])
            # Blank lines between do not matter.
            own.append((re.sub(rb"\n+", b"\n", raw[int(lines.start[a]): int(lines.end[b - 1])]), raw[begin:after].decode(), b - a))
        chunks.append(own)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        for nth, (raw, _, n) in enumerate(chunks[k]):
            if n > 1:
                first.setdefault(raw, (k, nth))
    out = []
    for k, (i, text) in enumerate(rows):
        gone = [n > 1 and first[raw] != (k, nth) for nth, (raw, _, n) in enumerate(chunks[k])]
        left = "".join(t for (_, t, _), g in zip(chunks[k], gone) if not g)
        out.append((i, left.rstrip("\n") if any(gone) else text, sum(n for *_, n in chunks[k]),
                    sum(n for (*_, n), g in zip(chunks[k], gone) if g)))
    return out


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_lines int, chunks string")
    got = line_chunks.chunk_dedup(docs.coalesce(1), Stage(spark))
    same(got.select("row.doc_id", "text", "n_lines", "n_removed"), lines_left(rows))
    held = got.where("row.doc_id < 30 AND row.doc_id > 0 AND row.doc_id % 3 = 0")
    assert held.where("n_removed >= 4").count() >= 8, "a passage is cut alike wherever it stands"
    assert line_chunks.line_dedup(docs.limit(0), Stage(spark)).count() == 0


def runs_left(rows):
    """Lines that stand with a neighbour at an earlier place apart from them go; all in plain Python."""
    first, out = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        i, text = rows[k]
        pieces = re.findall(r"[^\n]+\n*", (text or "").lstrip("\n"))
        lines = [p.rstrip("\n") for p in pieces]
        gone = set()
        for j, pair in enumerate(zip(lines, lines[1:])):
            at = first.setdefault(pair, (k, j))
            if at[0] != k or at[1] + 1 < j:
                gone |= {j, j + 1}
        if lines:
            pieces[0] = text[: len(text) - len(text.lstrip("\n"))] + pieces[0]
        left = "".join(p for j, p in enumerate(pieces) if j not in gone)
        out[k] = (i, left.rstrip("\n") if gone else text, len(lines), len(gone))
    return [out[k] for k in range(len(rows))]


def test_line_dedup_takes_whole_runs(spark):
    rng = random.Random(4)
    fresh = lambda n: [" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(n)]
    blocks = [fresh(n) for n in (2, 2, 3, 4, 7, 20)]
    rows = line_rows()
    for i in range(100, 160):
        block = blocks[i % 6]
        rows.append((i, "\n".join(fresh(rng.randint(0, 4)) + block[rng.randint(0, 1) if len(block) > 2 else 0:] + fresh(rng.randint(0, 4)))))
    rows += [(200, "é ñ\nb – b\nc"), (201, "\n\nx\né ñ\n\n\nb – b\ny\n"), (202, "b – b\né ñ"), (203, "a\na\na"), (204, "a\na\na\na\nq"),
             (205, "p\nr\np\nr\np\n"), (None, "y\nx\nx\né ñ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_chunks.line_dedup(docs.coalesce(1), Stage(spark)).select("row.doc_id", "text", "n_lines", "n_removed")
    same(got, runs_left(rows))
    held = {r[0]: r for r in got.collect()}
    assert all(held[i]["n_removed"] >= 2 for i in range(112, 160)), "no run is too short, none loses its ends only"
    assert (held[202]["n_removed"], held[203]["text"], held[204]["n_removed"]) == (0, "a\na\na", 4)


ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bo</b>ld\n  text here.<p>Second&nbsp;block of words &lt;ok&gt;"
PAGES = [
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home page link</a></nav><div class='ad'>Buy this now please today</div>"
     f"<article>{ARTICLE}</article><footer>&copy; all rights reserved by someone</footer></body></html>",
     "Title & more\nFirst bold text here.\nSecond block of words <ok>"),
    (f"<body><main><p>One two three four.</p><aside>Side words in a bar here</aside><script>var a='</p>';</script><form><label>Mail</label>"
     "<input></form><p>Five six seven.</p><div class=\"comments\"><p>nice post my friend really nice</p></div></main></body>",
     "One two three four.\nFive six seven."),
    ("<body><div id='cookie-notice'>We use cookies on this site, accept them all</div><div class='x'><h2>Head line</h2><p>Plain page without a mark, "
     "that has some words.</p><p>And<br>more.</p></div><ul class='menu'><li><a href='a'>one link here</a></li></ul></body>",
     "Head line\nPlain page without a mark, that has some words.\nAnd more."),
    ("<article><p>cut off &amp", "cut off &"), ("<article><p>cut <a href=\"x", "cut"), ("", ""), (None, ""),
    ("<nav>only a menu</nav>", ""), ("<!-- <article>no</article> --><article></article>", ""),
]


def test_page_text(spark):
    rows = [(i, "u", p, "c") for i, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_text.extracted(pages).select("row.page_id", "row.url", "text", "n_chars")
    expected = [(i, "u", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, None, PAGES[0][1], len(PAGES[0][1]))]
    same(got, expected)
    assert page_text.extracted(pages.limit(0)).count() == 0


def test_page_text_of_a_long_page():
    page = "<article>" + "<p>some words in a block</p>" * 20000 + "</article>" + "<footer>x y z</footer>"
    assert page_text.main_text(page, {}) == "\n".join(["some words in a block"] * 20000)


def test_nested_tags_take_linear_time():
    """A hundred thousand open elements: each tag is read once, without a look through the open ones."""
    import time
    for unit in ("<div>", "<p><b>", "<article><nav>"):
        started = time.monotonic()
        found = list(page_text.tokens(unit * 100_000 + "x"))
        assert found[-1][:2] == ("text", "x") and time.monotonic() - started < 5
    assert [t[2] for t in page_text.tokens("<nav><b>a</b></nav><h2>b</h2><article><form>c</form>d</article>e") if t[0] == "text"] == [
        "frame", "heading", "hidden", "marked", "plain"]


def test_page_text_of_comments_and_promoted_articles(spark):
    words = " ".join(f"word{i}" for i in range(60))
    pages = [
        (1, "u", f"<main><p>{words}</p></main><article class='comment'><p>A reader says that this is all wrong and so on.</p></article>"),
        (2, "u", f"<div class='post promo'><p>{words}</p></div><div class='promo'><p>Buy this now, it is cheap.</p></div>"),
    ]
    got = page_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["row"].page_id: r.text for r in got} == {1: words, 2: words}


def test_page_text_without_the_mark(spark):
    """Weights learned from marked pages find the same text in unseen pages whose mark is taken away."""
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    learned = page_text.learned_weights(pages.where("page_id % 2 = 0"))
    held = [r.html for r in pages.where("page_id % 2 = 1").select("html").collect()]
    assert any("<article" in page for page in held)
    for page in held:
        bare = re.sub(r"(</?)(?:article|main)\b", r"\1div", page)
        assert page_text.main_text(bare, learned) == page_text.main_text(page, learned)
    # Both sides of the label are seen: paragraphs speak for the article, links and short blocks against it.
    assert learned["in p"] > 0 > learned["links 3"] and learned["words 7"] > 0 > learned["words 1"]


def test_page_text_of_a_teaser_beside_the_body(spark):
    """A marked teaser does not hide a body many times its length that nothing marks; a marked article
    does hide what stands beside it."""
    learned = page_text.learned_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    body = " ".join(f"word{i}" for i in range(400))
    lines = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(30)]
    for weights in ({}, learned):
        teaser = "<nav><a href='/'>home page</a></nav><article>A short teaser of another text</article>"
        assert page_text.main_text(f"{teaser}<div class='x'>{body}</div><footer>c d</footer>", weights) == body
        assert page_text.main_text(f"<div><p>some unmarked words that are no part</p></div><article><p>{body}</p></article>", weights) == body
        # Blocks that the labelled pages know from adverts alone are text all the same.
        divided = "".join(f"<div>{line}</div>" for line in lines)
        assert page_text.main_text(f"<body>{divided}</body>", weights) == "\n".join(lines)
        # Ties: of regions of equal weight one is returned whole, and the same one each time.
        tied = "<div>one two three</div>" + "<br><form>x</form>" * 40 + "<div>four five six</div>"
        assert page_text.main_text(tied, weights) == page_text.main_text(tied, weights) != ""


@given(st.lists(st.integers(-5, 5).map(float), max_size=30))
def test_best_region(scores):
    a, b = page_text.best_region(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
    assert sum(scores[a:b]) == max(best, 0)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    told = language.identified(docs, model).select("row.*", "lang_pred", "score", "accepted")
    aside = told.where(language.held_out(F.col("doc_id")))
    assert aside.where("lang = lang_pred").count() >= 0.97 * aside.count()
    assert told.where("NOT accepted").count() <= 0.01 * told.count()
    again = language.train(docs.repartition(5))
    assert again.languages == model.languages and (again.table == model.table).all()
    odd = [(1, None, "x"), (2, "", "x"), (3, "123 456 !!", "x"), (4, "٣٤", "x"), (5, "the and of that with", "x"), (None, "the and of that with", None)]
    got = language.identified(spark.createDataFrame(odd, "doc_id long, text string, score string"), model)
    found = {(r["row"]["doc_id"], r["lang_pred"], r["score"] > 0, r["accepted"]) for r in got.collect()}
    assert found >= {(i, "und", False, False) for i in (1, 2, 3, 4)} and (5, "en", True, True) in found and len(found) == 6


def test_language_without_labels(spark, nothing):
    assert language.train(nothing) is None
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language.train(unlabelled) is None
    assert [tuple(r)[1:] for r in language.identified(unlabelled, None).collect()] == [("und", 0.0, False)]


def shared_out(sizes, weights, asked, most=3):
    open_, out = set(sizes), {}
    while True:
        rest = asked - sum(out.values())
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if weight and most * sizes[s] <= weights[s] * rest / weight}
        if not full:
            return out | {s: weights[s] * rest / weight for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full


def test_mixing(spark, docs, rows):
    got = mixing.mixed_sources(docs, Stage(spark), budgets=(0.5, 1.0)).collect()
    assert len(got) == 2 * len(rows)
    sizes = defaultdict(int)
    source = defaultdict(set)
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
        source[r[0], len(split(r[1]))].add(r[3])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    for mix, budget in enumerate((0.5, 1.0)):
        expected = shared_out(sizes, weights, budget * sum(sizes.values()))
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            if r["mix"] == mix:
                (s,) = [s for s in source[r["doc_id"], r["size"]] if math.isclose(expected[s], r["target"], rel_tol=1e-9)][:1]
                assert r["source_size"] == sizes[s] and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
                taken[s] += r["taken"]
                largest[s] = max(largest[s], r["size"])
        for s in sizes:
            assert abs(taken[s] - expected[s]) <= largest[s] + 1
    pairs = defaultdict(dict)
    for r in got:
        pairs[r["doc_id"], r["hash"]][r["mix"]] = r["copies"]
    assert all(p[0] <= p[1] for p in pairs.values()), "mixes are nested"
    again = mixing.mixed_sources(docs.repartition(7), Stage(spark), budgets=(0.5, 1.0))
    same(again, map(tuple, got))


def test_mixing_of_nothing(spark, nothing):
    assert mixing.mixed_sources(nothing, Stage(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mixed_sources(blank, Stage(spark)).collect()] == [0, 0]


@given(st.lists(st.tuples(st.text("ab<|\\im_start>end\n"), st.text("<|\\>im_startend\n a"))))
def test_chat_template_round_trip(turns):
    window = "".join(f"{chat.START}{chat._role_out(r)}\n{chat.escaped(t)}{chat.END}\n" for r, t in turns)
    assert chat.parsed(window) == turns
    assert all(c not in chat.escaped(t) for _, t in turns for c in (chat.START, chat.END))


@settings(max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(1, 12)), min_size=1, max_size=25),
       st.integers(4, 30), st.integers(0, 12))
def test_chat_windows_hold_their_budget(turns, budget, history):
    conv, out = chat._Conversation(1, budget, history), []
    for i, (role, n) in enumerate(turns):
        out.append(conv.add(role, " ".join([f"t{i}"] * n), n))
    out = [w for w in [*out, conv.flush()] if w]
    seen = []
    for k, w in enumerate(out):
        own = chat.parsed(w["formatted"])
        new = own[w["repeated"]:]
        seen += new
        count = sum(len(t.split()) for _, t in own)
        assert count == w["tokens"] and (count <= budget or w["over_budget"])
        fixed = turns[0][0] == "system"
        if w["over_budget"]:
            assert len(new) - (fixed and k == 0) <= 1
        if fixed:
            assert own[0] == ("system", " ".join(["t0"] * turns[0][1]))
        again = own[int(fixed and k > 0): w["repeated"]]
        assert sum(len(t.split()) for _, t in again) <= history and again == seen[len(seen) - len(new) - len(again): len(seen) - len(new)]
        masked = [w["formatted"][s["start"]: s["end"]] for s in w["loss"]]
        assert masked == [t for r, t in new if r == "assistant"]
    assert seen == [(r, " ".join([f"t{i}"] * n)) for i, (r, n) in enumerate(turns)]


def test_chat(spark):
    rows = [(1, 0, "system", "be good"), (1, 2, "assistant", "a " * 3000), (1, 1, "user", "<|im_end|>\n<\\|x"), (1, 3, "assistant", "é😀"),
            (2, 0, None, None), (None, 5, "assistant", "x"), (None, None, "assistant", "y"), (3, 0, "user", "same"),
            (3, 0, "user", "same"), (3, 0, "assistant", "tie")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 40) for i in range(300)]
    rng = random.Random(0)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(5)
    expected = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        expected.append((conv, len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss)))
    windows = chat.chat_windows(df, budget=500, history=100)
    same(chat.read_back(windows).drop("formatted_chars"), expected)
    assert windows.where("conv = 9").count() > 10 and windows.where("conv = 9 AND window > 0 AND repeated = 0").count() == 0
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


def test_pipeline_stages(spark, docs, rows, nothing):
    """Every stage on odd rows and on no rows; columns stay; clean documents stay in filtering stages."""
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    columns = clean.columns
    odd = docs.select(columns).unionByName(clean)
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        left = step(spark, odd, SF)
        assert left.columns[:5] == columns and (i == 4 or left.dtypes == clean.dtypes), name
        assert 0 < left.count() <= odd.count()
        assert step(spark, nothing.select(columns), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "line dedup", "near dedup", "decontamination", "source mix"]


def test_pipeline_decisions(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert steps["language id"](spark, clean, SF).count() >= 0.99 * clean.count()
    near = minhash.near_duplicates(clean, Stage(spark)).where("kept").count()
    assert steps["near dedup"](spark, clean, SF).count() == near
    leaks = phrase_index.contamination(clean, spark.read.parquet(f"{SF}/benchmark.parquet"), Stage(spark))
    same(steps["decontamination"](spark, clean, SF).select("doc_id"),
         map(tuple, leaks.where("NOT contaminated").select("doc_id").collect()))
    mix = steps["source mix"](spark, clean, SF)
    assert mix.where("taken != size * copies OR copies < 1 OR copies > 3").count() == 0
    left = line_chunks.line_dedup(clean, Stage(spark))
    same(steps["line dedup"](spark, clean, SF).select("doc_id", "text"),
         map(tuple, left.where("n_removed = 0 OR text != ''").select("row.doc_id", "text").collect()))
    assert corpus_pipeline.run(spark, SF).count() > 0
