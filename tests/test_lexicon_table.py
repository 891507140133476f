"""Lexicons as joined tables against the pattern way."""

import random

import pytest
from pyspark.sql import functions as F

from lawtide.functions.lexicon import HR_SCOPE, Scope
from lawtide.operators.lexicon_table import lexicon_rows, match_lexicon, stem_candidates, word_windows, written_out
from lawtide.operators.prefilter import match_scopes
from lawtide.sources.workspace import Stage

LEXICON = "scope string, topic string, pattern string"


def lexicon(spark, *scopes):
    return spark.createDataFrame(lexicon_rows(scopes), LEXICON)


def found(df):
    return sorted((r.i, r.scope, r.threshold, tuple(r.topics)) for r in df.collect())


def texts_of(seed, n):
    rng = random.Random(seed)
    stems = [s for group in HR_SCOPE.topics.values() for s in group] + list(HR_SCOPE.generic)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 12)):
            stem = rng.choice(stems).replace("(hatóság|ellenőrzés|felügyelőség)", rng.choice(["hatóság", "felügyelőség", "hivatal"]))
            words.append(rng.choice([stem, stem + "ek", "nem" + stem, stem[:-1], stem.upper(), "§" + stem, "szó"]))
        out.append(rng.choice([" ", ", ", "\n"]).join(words))
    return out


def test_same_topics_as_the_patterns(spark):
    tax = Scope("tax", {"vat": ("áfa", "adó"), "all": ("adó(zás|bevallás) rend",)}, ("pénz",), threshold=0.8)
    rows = [(i, t, f"{t} adózás rendje") for i, t in enumerate(texts_of(1, 300))]
    rows += [(900, None, None), (901, "", "pénzügy"), (902, "munka", None), (902, "munka", None)]
    df = spark.createDataFrame(rows, "i int, text string, note string").repartition(3)
    thresholds = spark.createDataFrame([("tax", 0.8)], "scope string, threshold double")
    for context in (None, "note"):
        expected = match_scopes(df, [HR_SCOPE, tax], context=context)
        got = match_lexicon(df, lexicon(spark, HR_SCOPE, tax), Stage(spark), context=context, thresholds=thresholds)
        assert got.columns == expected.columns and found(got) == found(expected) != []


def test_stems_that_begin_beyond_words(spark):
    odd = Scope("odd", {"law": ("§ 1", "- a"), "w": ("b",)})
    df = spark.createDataFrame([(1, "x § 12"), (2, "y§ 1"), (3, "- ab"), (4, "ab b")], "i int, text string")
    assert found(match_lexicon(df, lexicon(spark, odd), Stage(spark))) == found(match_scopes(df, [odd])) != []


def test_written_out(spark):
    rows = [("s", "t", "a (b|c) d (e|f)"), ("s", None, "x|y"), ("s", "t", ""), ("s", "t", None), ("s", "t", "((p|q)r|z)")]
    got = written_out(spark.createDataFrame(rows, LEXICON)).collect()
    assert sorted((r.topic or "", r.stem) for r in got) == [
        ("", "x"), ("", "y"), ("t", "a b d e"), ("t", "a b d f"), ("t", "a c d e"), ("t", "a c d f"), ("t", "pr"), ("t", "qr"), ("t", "z")]
    with pytest.raises(ValueError, match="plain stem"):
        written_out(spark.createDataFrame([("s", "t", "a.*b")], LEXICON))


def test_two_hundred_thousand_stems(spark):
    """Fifty scopes: topics as told by the words themselves, in a plan no larger than for one."""
    large = spark.range(200_000).select(
        F.concat(F.lit("s"), F.col("id") % 50).alias("scope"), F.concat(F.lit("t"), F.col("id") % 7).alias("topic"),
        F.concat(F.lit("stem"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"))
    df = spark.range(400).select(
        F.col("id").alias("i"), F.concat(
            F.lit("egy stem"), F.lpad((F.col("id") * 499).cast("string"), 6, "0"), F.lit("ben, nemstem000001 Stem000"),
            F.lpad((F.col("id") % 200).cast("string"), 3, "0")).alias("text"))
    got = match_lexicon(df, large, Stage(spark))
    expected = set()
    for i in range(400):
        for n in {i * 499, i % 200}:
            expected.add((i, f"s{n % 50}", f"t{n % 7}"))
    rows = [(r.i, r.scope, t) for r in got.collect() for t in r.topics]
    assert sorted(rows) == sorted(expected)
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    one = match_lexicon(df, large.where("scope = 's1'"), Stage(spark))
    assert size(got) < 1.05 * size(one)


def test_empty_lexicon_and_texts(spark):
    df = spark.createDataFrame([(1, "munka")], "i int, text string")
    none = spark.createDataFrame([], LEXICON)
    assert match_lexicon(df, none, Stage(spark)).count() == 0
    assert match_lexicon(df.limit(0), lexicon(spark, HR_SCOPE), Stage(spark)).count() == 0


def test_beginnings_of_lengths_under_a_head_alone(spark):
    """Words without a stem's head are cut off nowhere, others at the lengths of stems with that head."""
    stems = ["abcd", "abcdefg", *("x" * n for n in range(5, 18))]
    scopes = [Scope("s", {s: (s,) for s in stems}), Scope("odd", {"dash": ("abcd - e",), "t": ("abcdé",)})]
    texts = ["abcdefghij kirja kirjat Kirja §abcdé", "ABCD abcd, abc xxxxxxx", "nabcd _abcd abcd - ef", "", None, "kirja" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for chosen in (scopes[:1], scopes):
        assert found(match_lexicon(df, lexicon(spark, *chosen), Stage(spark))) == found(match_scopes(df, chosen)) != []
    heads = spark.createDataFrame([("abcd", [4, 7]), ("xxxx", list(range(5, 18)))], "head string, lengths array<int>")
    for in_word in (True, False):
        windows = df.select(
            F.col("i").alias("_row"), F.explode(word_windows(F.lower("text"), 4, 17, True, in_word)).alias("window"))
        got = {(r._row, r.stem.split(" ")[0]) for r in stem_candidates(windows, heads, 4).collect()}
        assert {x for x in got if not x[1].startswith("abcd")} == {(1, "xxxxx"), (1, "xxxxxx"), (1, "xxxxxxx")}
        assert {(0, "abcd"), (0, "abcdefg"), (1, "abcd"), (2, "abcd")} <= got
