"""Topics of any number of scopes from a lexicon that is a table and joins the texts.

A stem matches at a word start and takes any ending. The first characters at a word start, as many as
the shortest stem has, are joined with the heads of the stems; only where they are one, beginnings of
the lengths of the stems with that head are cut off, and those equal to a stem are hits. The plan
holds two lengths alone: it does not grow with the number of stems or scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.functions.lexicon import searched_text
from lawtide.functions.text import WORD_CHAR
from lawtide.sources.workspace import Stage

#: Pattern syntax beyond alternatives, which no beginning of a word can be compared with.
SYNTAX = r"[\\\[\]{}^$.?*+]"


def written_out(lexicon: DataFrame) -> DataFrame:
    """Rows (scope, topic, stem) of a lexicon (scope, topic, pattern): every alternative a stem of its own.

    A null topic holds generic stems, which count as a hit and name no topic. Empty and null patterns
    are left out; other pattern syntax raises.
    """
    rows = lexicon.select("scope", "topic", F.col("pattern").alias("stem")).where("stem != ''")
    groups = F.length("stem") - F.length(F.translate("stem", "(", ""))
    told = rows.agg(
        F.max(groups).alias("groups"), F.max(F.when(F.col("stem").rlike(SYNTAX), F.col("stem"))).alias("odd")).first()
    if told.odd is not None:
        raise ValueError(f"not a plain stem: {told.odd}")
    part = lambda i: F.regexp_extract("stem", r"^(.*?)\(([^()]*)\)(.*)$", i)
    for _ in range(told.groups or 0):
        choices = F.transform(F.split(part(2), r"\|"), lambda c: F.concat(part(1), c, part(3)))
        rows = rows.withColumn(
            "stem", F.explode(F.when(F.col("stem").contains("("), choices).otherwise(F.array("stem"))))
    rows = rows.withColumn("stem", F.explode(F.split("stem", r"\|")))
    return rows.where("stem != ''").distinct()


def word_windows(searched: Column, shortest: int, longest: int, from_word: bool, in_word: bool) -> Column:
    """Distinct stretches from the word starts of a text that are long enough for a stem, and hold the longest;
    `from_word`: a word character comes first, else any character that none precedes; `in_word`: stems
    have word characters alone, so these are whole words, and far fewer than stretches that run on."""
    if in_word:
        return F.array_distinct(F.regexp_extract_all(searched, F.lit(f"[{WORD_CHAR}]{{{shortest},}}"), F.lit(0)))
    first = f"[{WORD_CHAR}]" if from_word else "."
    window = rf"(?s)(?<![{WORD_CHAR}])(?=({first}.{{{shortest - 1},{longest - 1}}}))"
    return F.array_distinct(F.regexp_extract_all(searched, F.lit(window), F.lit(1)))


def stem_candidates(windows: DataFrame, heads: DataFrame, shortest: int) -> DataFrame:
    """(_row, stem): beginnings of the windows (_row, window), of the lengths that stems with their head
    have (heads: head, lengths)."""
    fits = F.filter("lengths", lambda n: n <= F.length("window"))
    return (
        windows.withColumn("head", F.substring("window", 1, shortest)).join(heads, "head")
        .select("_row", "window", F.explode(fits).alias("n"))
        .select("_row", F.substring(F.col("window"), F.lit(1), F.col("n")).alias("stem")))


def match_lexicon(
    df: DataFrame, lexicon: DataFrame, stage: Stage, text: str = "text", context: str | None = None,
    thresholds: DataFrame | None = None, default: float = 0.50, name: str = "lexicon",
) -> DataFrame:
    """One row per row of df and scope whose lexicon it hits: its columns, scope, threshold, topics.

    lexicon: (scope, topic, pattern) of any size; thresholds: (scope, threshold), `default` for scopes
    without one. Rows of df travel once, by number, to their hits; beginnings meet heads and stems by
    equi-joins, for which Spark broadcasts a lexicon it has measured as small. topics is sorted and
    empty where generic stems alone were hit. null texts hit nothing; repeated rows are judged each.
    """
    stems = stage(written_out(lexicon), f"{name}_stems")
    told = stems.agg(
        F.min(F.length("stem")).alias("shortest"), F.max(F.length("stem")).alias("longest"),
        F.min(F.col("stem").rlike(f"^[{WORD_CHAR}]")).alias("from_word"),
        F.min(F.col("stem").rlike(f"^[{WORD_CHAR}]+$")).alias("in_word")).first()
    shortest = told.shortest or 1
    heads = stage(
        stems.groupBy(F.substring("stem", 1, shortest).alias("head"))
        .agg(F.array_sort(F.collect_set(F.length("stem"))).alias("lengths")), f"{name}_heads")
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), f"{name}_rows")
    searched = searched_text(F.col(text), None if context is None else F.col(context))
    windows = (
        word_windows(searched, shortest, told.longest, told.from_word, told.in_word)
        if told.longest else F.array().cast("array<string>"))
    hits = (
        stem_candidates(rows.select("_row", F.explode(windows).alias("window")), heads, shortest).join(stems, "stem")
        .groupBy("_row", "scope").agg(F.array_sort(F.collect_set("topic")).alias("topics")))
    if thresholds is not None:
        hits = hits.join(thresholds.select("scope", F.col("threshold").alias("_threshold")), "scope", "left")
    threshold = F.lit(default) if thresholds is None else F.coalesce("_threshold", F.lit(default))
    return rows.join(hits.withColumn("threshold", threshold.cast("double")), "_row").select(
        *df.columns, "scope", "threshold", "topics")


def lexicon_rows(scopes) -> list[tuple[str, str | None, str]]:
    """Rows (scope, topic, pattern) of scopes that are configuration."""
    return [
        (s.name, topic, stem)
        for s in scopes for topic, stems in [*s.topics.items(), (None, s.generic)] for stem in stems]
