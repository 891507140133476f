"""Language-model scores by stupid backoff, from counts of all n-grams of the corpus.

Counts of each order are a table keyed by the n-gram's hash and partitioned by its leading bits.
A bundle of documents sends its distinct n-grams with their counts, which are summed per key;
what comes back is the count in the corpus of each n-gram that was sent, and scores are summed per
document. Orders follow one another, so the n-grams of one order alone are under way at a time. No n-gram is left out and nothing is kept per vocabulary in a task or the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.llm.bundles import (
    BATCH_BYTES, PACKED, REQUEST, answer, answers, bundled, first_bits, met, part_bits, request)
from lawtide.llm.words import SPACED, spans, words_of
from lawtide.sources.workspace import Stage, small_batches

#: Scores are summed in whole millionths, so sums do not depend on an order.
UNIT = 1_000_000


def _summed(values: np.ndarray, group: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin)[group]


class _Grams:
    """n-grams of one order within a bundle's texts: the word at which each ends and, of the bundle's
    sorted distinct keys, which one it is."""

    def __init__(self, hashes: np.ndarray, place: np.ndarray, n: int) -> None:
        self.end = np.flatnonzero(place >= n - 1)
        keys = spans(hashes, self.end - (n - 1), n)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.distinct = keys[begin]
        self.count = np.diff(np.append(begin, len(keys)))
        self.number = np.empty(len(keys), np.int64)
        self.number[order] = np.repeat(np.arange(len(begin)), self.count)

    def others(self, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For every word, how often the n-gram that ends there occurs in other documents; 0 where
        none of this order does. count: in the whole corpus, of the distinct keys."""
        key = (doc[self.end] << 32) + self.number
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        own = np.diff(np.append(begin, len(key)))
        out = np.zeros(len(doc), np.int64)
        out[self.end[order]] = count[self.number[order]] - np.repeat(own, own)
        return out


def _worded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a bundle, the place of each in its text, and where texts begin."""
    words = words_of(texts, SPACED, lower=True)
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.counts)
    return words.hashes(), place, words.first


def scored_words(others: list[np.ndarray], place: np.ndarray, doc_words: np.ndarray, total: int, alpha: float) -> np.ndarray:
    """Logarithm of the score of each word, in whole millionths.

    The highest order counts whose n-gram occurs elsewhere: its count over that of its first words;
    each order that is stepped over costs a factor alpha. A word seen nowhere else counts half.
    """
    size = len(place)
    rest = total - doc_words
    alone = np.maximum(others[0], 0.5) / np.maximum(rest, 1)
    top = np.minimum(place, len(others) - 1)
    score = alone * alpha ** top
    for n in range(1, len(others)):
        seen = np.flatnonzero(others[n] > 0)
        before = np.zeros(size, np.int64)
        before[1:] = others[n - 1][:-1]
        score[seen] = others[n][seen] / before[seen] * alpha ** (top[seen] - n)
    return np.rint(np.log(score) * UNIT).astype(np.int64)


def _asked(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, place, _ = _worded(batch["texts"][i].values)
                grams = _Grams(hashes, place, n)
                yield request(batch["bundle"][i].as_py(), grams.distinct, grams.count, bits)
    return run


def _scored(order: int, total: int, alpha: float):
    def run(bundle: pa.Table, said: pa.Table) -> pa.Table:
        hashes, place, first = _worded(bundle["texts"][0].values)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        others = [
            _Grams(hashes, place, n).others(answer(said.filter(pc.equal(said["n"], n))), doc)
            for n in range(1, order + 1)]
        score = scored_words(others, place, n_words[doc], total, alpha)
        sums = np.append(0, np.cumsum(score))
        units = sums[first[1:]] - sums[first[:-1]]
        return pa.table({
            "id": bundle["ids"][0].values, "n_words": pa.array(n_words, pa.int64()), "units": pa.array(units, pa.int64())})
    return run


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            n = len(words_of(batch["texts"][i].values, SPACED, lower=False).start)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def backoff_scores(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *,
    order: int = 3, alpha: float = 0.4,
) -> DataFrame:
    """One row per row of docs: the id, n_words, logprob (natural logarithm, summed over the words),
    mean_logprob (per word; null without words).

    Words are runs without white space, A-Z in lower case; n-grams do not cross documents. Counts are
    of all rows but the document's own, so a text is not judged by itself. The score of a word is
    count(h w) / count(h) for the longest context h, of order - 1 words at most, for which h w occurs
    elsewhere, times alpha for each word of context given up; a single word counts
    max(count, 1/2) / words of the other documents. null and blank texts score 0 with no words. Rows
    that repeat an id or a text count as documents each. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bundles = bundled(docs, stage, id_col, text_col).select("bundle", "ids", "texts")
    with small_batches(stage.spark, BATCH_BYTES):
        total = bundles.select("texts").mapInArrow(_n_words, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    bits, said = part_bits(total), []
    for n in range(1, order + 1):
        counts = answers(bundles.mapInArrow(_asked(n, first_bits(bits)), REQUEST), stage, f"counts_{n}", _summed, bits)
        said.append(counts.withColumn("n", F.lit(n)))
    return (
        met(bundles, reduce(DataFrame.unionByName, said), _scored(order, total, alpha), f"id {kind}, n_words long, units long")
        .select(F.col("id").alias(id_col), "n_words", (F.col("units") / UNIT).alias("logprob"),
                F.when(F.col("n_words") > 0, F.col("units") / UNIT / F.col("n_words")).alias("mean_logprob")))


# What words are made of, and the letters that are lowered.
_WORD, _UPPER, _LOWER = r"[^\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _grams_of_words(order: int) -> Column:
    """For every word the keys of the n-grams that end there (`k1`, `k2`, ...) and of those without their
    last word (`p2`, ...); null where the text begins too late."""
    def key(words: Column, n: int, end: Column) -> Column:
        return F.when(end >= n - 1, F.xxhash64(F.lit(n), F.slice(words, end - (n - 2), n)))

    words = F.col("words")
    return F.transform(words, lambda _, i: F.struct(
        *[key(words, n, i).alias(f"k{n}") for n in range(1, order + 1)],
        *[key(words, n - 1, i - 1).alias(f"p{n}") for n in range(2, order + 1)]))


def relational_scores(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *,
    order: int = 3, alpha: float = 0.4,
) -> DataFrame:
    """`backoff_scores` as joins, by DataFrame functions alone; the same rows for the same input.

    n-grams are exploded, a row per document and distinct n-gram; counts of each order are a table by the
    n-gram's hash, joined to them; what is left of a count without the document's own is joined to
    the words that ask for it, and scores are summed per document. Several rows of some twenty bytes
    travel for every word, so it takes more time and disk than the packed form.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = stage(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words")), "rows", **PACKED)
    total = rows.agg(F.sum(F.size("words").cast("long")).alias("n")).first()["n"] or 0
    keys = [*(f"k{n}" for n in range(1, order + 1)), *(f"p{n}" for n in range(2, order + 1))]
    grams = stage(
        rows.select("row", F.explode(_grams_of_words(order)).alias("g")).select("row", "g.*")
        .groupBy("row", *keys).agg(F.count(F.lit(1)).alias("times")), "grams", **PACKED)

    told = grams
    for n in range(1, order + 1):
        own = grams.where(f"k{n} IS NOT NULL").groupBy("row", F.col(f"k{n}").alias("key")).agg(F.sum("times").alias("own"))
        counts = stage(own.groupBy("key").agg(F.sum("own").alias("n")), f"count_{n}", **PACKED)
        others = stage(
            own.join(counts, "key").select("row", "key", (F.col("n") - F.col("own")).alias("others")), f"others_{n}", **PACKED)
        asking = [(f"k{n}", f"n{n}"), *([(f"p{n + 1}", f"before{n + 1}")] if n < order else [])]
        for key, name in asking:
            told = told.join(
                others.select("row", F.col("key").alias(key), F.col("others").alias(name)), ["row", key], "left")

    sizes = rows.select("id", "row", F.size("words").cast("long").alias("n_words"))
    top = F.greatest(*[F.when(F.col(f"k{n}").isNotNull(), n - 1) for n in range(1, order + 1)], F.lit(0))
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    score = F.greatest(F.col("n1").cast("double"), F.lit(0.5)) / rest * F.pow(F.lit(alpha), top)
    for n in range(2, order + 1):
        score = F.when(F.col(f"n{n}") > 0, F.col(f"n{n}") / F.col(f"before{n}") * F.pow(F.lit(alpha), top - (n - 1))).otherwise(score)
    units = F.rint(F.log(score) * UNIT).cast("long") * F.col("times")
    summed = told.join(sizes.select("row", "n_words"), "row").groupBy("row").agg(F.sum(units).alias("units"))
    units = F.coalesce("units", F.lit(0))
    return sizes.join(summed, "row", "left").select(
        F.col("id").alias(id_col), "n_words", (units / UNIT).alias("logprob"),
        F.when(F.col("n_words") > 0, units / UNIT / F.col("n_words")).alias("mean_logprob"))
