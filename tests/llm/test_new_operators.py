"""Periodic runs, URL rules and the Merkle manifest against brute force, edge cases included."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawtide.llm import merkle, periodic, queries, url_rules
from lawtide.llm.words import U, mixed
from lawtide.sources.workspace import Stage

ODD = "doc_id long, text string, runs string, id string, n_words int, collapsed int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least=6, times=4):
    """Runs by their definition: agreement at every distance, smallest period first."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.6:
                unit = [f"w{rng.randrange(rng.choice([2, 3, 40]))}" for _ in range(rng.randint(1, 9))]
                words += (unit * rng.randint(1, 8))[rng.randint(0, 3):]
            else:
                words += [f"w{rng.randrange(4)}" for _ in range(rng.randint(1, 9))]
        if texts and rng.random() < 0.2:
            words += (rng.choice(texts) or "").split()
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts


def test_periodic_runs(spark):
    texts = periodic_texts(1, 150)
    texts += [None, "", " \n ", "a", "a a a a a", "a a a a a a", "é é é é é é é\u00a0é", " ".join(["x y"] * 4),
              " ".join(["n"] * 30000), " ".join(f"u{i}" for i in range(30000)), texts[3], texts[3]]
    rows = [(i, t, "r", "i", 1, 2) for i, t in enumerate(texts)] + [(None, texts[5], None, None, None, None), (3, texts[4], "", "", 0, 0)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, ODD).repartition(4)).collect()
    expected = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 30000, 1)] if words[:1] == ["n"] else [] if words[:1] == ["u0"] else plain_runs(words)
        expected.append((i, len(words), tuple(runs), collapsed(words, runs)))
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == Counter(expected)


def test_periodic_runs_of_nothing(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], ODD)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], ODD), times=3)


def test_runs_whose_hashes_lie():
    """Two Thue-Morse words of the same length have one polynomial hash modulo 2 ** 64."""
    word = np.array([bin(i).count("1") % 2 for i in range(1 << 12)])
    one, two = word[:2048], word[2048:]
    ids = np.concatenate([one, two, one, two, one, [5], one, one, one, one, two])
    hashes = mixed(ids.astype(U) + U(7))
    ids = np.unique(hashes, return_inverse=True)[1]
    got = periodic.runs_of(ids, hashes, np.array([0, len(ids)]), 6, 4)
    assert all(np.array_equal(a, b) for a, b in zip(got, periodic.by_distance(ids, 6, 4)))
    assert (5 * 2048 + 1, 9 * 2048 + 1, 2048) in list(zip(*(x.tolist() for x in got)))


def test_op11_made_runs(spark, tmp_path):
    """The query's repetition of words, and its digests."""
    import zlib
    rows = [(i, t) for i, t in enumerate(periodic_texts(2, 60) + [None, "", "one"])] + [(None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[x if x < a else a + (x - a) % p] for x in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        expected.append((
            i, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
            sha("".join(f"{s},{x},{q}\n" for s, x, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(collapsed(words, runs))))
    assert Counter(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect())) == Counter(expected)


LABELS = ["a", "b", "com", "org", "x-y", "", "ab"]


def test_url_verdicts(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(LABELS) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["a", "b", "ab", "", "é"]) for _ in range(rng.randint(0, 4)))
    rules = [(host() if rng.random() > 0.05 else "", path(), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [("a.com", "/a", "allow"), ("a.com", "/a", "block"), ("ORG", "/up", "block"), (None, "/none", "block"), ("b", None, "allow")]
    urls = [None, "", "foo", "http://", "://", "http://ORG/x?y", "http://a.org", "http://a.org#f/x", "x://a.org/a://b/c",
            "http://a.com/\n/a", "http://a.com/" + "a/" * 20000, "http://A.com:80/a", "http://É.com/a"]
    urls += ["http://" + host() + path() + rng.choice(["", "?q", "#a"]) for _ in range(500)] + ["http://a.com/a/b"] * 300
    rows = [(i, u, "h", 1, 2, 3) for i, u in enumerate(urls)] + [(0, "http://a.com/a/b", "h", 1, 2, 3), (None, None, None, None, None, None)]

    def expected(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        h, p = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = []
        for rule_host, rule_path, verdict in rules:
            rule_host, rule_path = (rule_host or "").lower(), rule_path or ""
            if (rule_host == "" or h == rule_host or h.endswith("." + rule_host)) and p.startswith(rule_path):
                fits.append((len(rule_host + rule_path), len(rule_host), rule_host + rule_path, verdict))
        best = max(fits, default=(0, 0, None, "allow"))
        return h, p, best[2], best[3]

    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row int, rule int, nth int").repartition(3)
    ruled = spark.createDataFrame(rules, "host string, path string, verdict string")
    wide = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        for merged in ("true", "false"):
            spark.conf.set(wide, merged)
            spark.conf.set("spark.sql.shuffle.partitions", "4" if merged == "true" else "13")
            got = url_rules.url_verdicts(pages, ruled, Stage(spark)).select("row.page_id", "host", "path", "rule", "verdict").collect()
            assert Counter(map(tuple, got)) == Counter((r[0], *expected(r[1])) for r in rows)
    finally:
        spark.conf.unset(wide)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    nothing = pages.limit(0)
    assert url_rules.url_verdicts(nothing, ruled, Stage(spark)).count() == 0
    without = url_rules.url_verdicts(pages, ruled.limit(0), Stage(spark), default="block")
    assert {tuple(r) for r in without.select("rule", "verdict").collect()} == {(None, "block")}


def test_url_filters_stay_native(spark):
    plan = queries.op12_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("InArrow|InPandas|Python|CartesianProduct|NestedLoopJoin", plan)


def joined_up(leaves, fanout):
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, p in enumerate(at):
            head = p - p % fanout
            proofs[i].append((nodes[head:p], nodes[p + 1: head + fanout]))
            at[i] = p // fanout
        nodes = [sha("".join(nodes[i: i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


@pytest.mark.parametrize("fanout, depth, n", [(3, 1, 130), (3, 2, 300), (2, 1, 90), (5, 5, 200)])
def test_manifest(spark, fanout, depth, n):
    rng = random.Random(n)
    pick = lambda: rng.choice([None, "", "a", "a", "a", "é", "z"]) if rng.random() < 0.7 else f"s{rng.randrange(12)}"
    rows = [(i, pick(), rng.choice([f"t{i}", None, "", "ü" * 5000]), 1, 2, 3) for i in range(n)]
    rows += [rows[0], (rows[0][0], rows[0][1], "other", 1, 2, 3), (None, "a", "x", 1, 2, 3), (None,) * 6, (None,) * 6]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, block int, `group` int, nth int").repartition(5)
    leaf = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text"))
    got = merkle.manifest(docs.withColumn("leaf", leaf), Stage(spark), fanout=fanout, depth=depth).select(
        "row.*", "subroot", "root", "proof", merkle.folded(F.col("leaf"), F.col("proof")).alias("up"),
        merkle.proof_digest(F.col("proof")).alias("digest")).collect()
    groups = {}
    for r in rows:
        made = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:3])
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), sha(made), r[:3]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        trees[name] = joined_up([x[1] for x in groups[name]], fanout)
    root, above = joined_up([trees[name][0] for name in names], fanout)
    expected = [
        (str(x[2]), x[1], trees[name][0], root, repr(own + up))
        for name, up in zip(names, above) for x, own in zip(groups[name], trees[name][1])]
    assert Counter(expected) == Counter(
        (str((r.doc_id, r.source, r.text)), r.leaf, r.subroot, r.root, repr([(p.before, p.after) for p in r.proof])) for r in got)
    assert all(r.up == r.root for r in got)
    assert all(r.digest == sha("".join(h for p in r.proof for h in [*p.before, *p.after])) for r in got)


def test_manifest_of_nothing_and_one(spark):
    docs = spark.createDataFrame([(1, "s", "x")], "doc_id long, source string, leaf string")
    assert merkle.manifest(docs.limit(0), Stage(spark)).count() == 0
    one = merkle.manifest(docs, Stage(spark)).first()
    assert (one.subroot, one.root, one.proof) == ("x", "x", [])
