"""Benchmark decontamination with a stored positional inverted index.

The index is sharded by document: a task packs the documents it reads into shards of about a million
words, and a row of the index table holds one shard: its documents, the sorted hashes of its terms, and
for every term the ascending positions at which it stands. Postings never leave their shard, so a term
that is in every document is as long a list as the shard has words, and no key is hot.

Queries are a stated set (benchmark items): they are taken in blocks of bounded text, each block is
sent to all tasks and meets every shard. A phrase is looked up from its rarest term in the shard: that
term's positions, less its offset in the phrase, are the candidate starts, and the lists of the other
terms, next rarest first, each less its own offset, are intersected with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawtide.llm.packing import ascending, planes, unascending, unplaned
from lawtide.llm.words import LETTERED, U, slices, words_of
from lawtide.sources.workspace import Stage

SHARD_WORDS = 1 << 20
#: Text of a block of queries that is sent to all tasks.
BLOCK_BYTES = 16 << 20
#: Candidates that are held at a time.
CANDIDATES = 1 << 21


def _packed(ids: list, counts: list, hashes: list, id_type) -> pa.RecordBatch:
    terms = np.concatenate(hashes)
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    begin = np.flatnonzero(np.diff(terms, prepend=~terms[:1])) if len(terms) else np.zeros(0, np.int64)
    steps = order.astype(np.uint32)
    steps[1:] -= order[:-1].astype(np.uint32)
    steps[begin] = order[begin]
    number = np.diff(np.append(begin, len(terms))).astype(np.uint32)
    cells = (ascending(terms[begin]), planes(number), planes(steps))
    return pa.RecordBatch.from_arrays(
        [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(id_type)),
         pa.array([np.concatenate(counts)], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)],
        ["ids", "n_words", "terms", "counts", "steps"])


def _indexed(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, hashes, held, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch["id"].type
            for a, b in slices(batch["text"]):
                words = words_of(batch["text"].slice(a, b - a), LETTERED, lower=True)
                ids.append(batch["id"].slice(a, b - a))
                counts.append(words.counts)
                hashes.append(words.hashes())
                held += len(words.start)
                if held >= shard_words:
                    yield _packed(ids, counts, hashes, kind)
                    ids, counts, hashes, held = [], [], [], 0
        if ids:
            yield _packed(ids, counts, hashes, kind)
    return run


def build_index(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *,
    shard_words: int = SHARD_WORDS, name: str = "index",
) -> DataFrame:
    """Writes the index and returns it: (shard, ids, n_words, terms, counts, steps), a row per shard.

    Words are ASCII letters and digits and all beyond ASCII, A-Z in lower case; every word of every
    text is posted. A document is in one shard whole, so one of any length may stretch its shard.
    null texts have no words; ids may be null or repeat, as a document is known by its shard and place.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = rows.mapInArrow(
        _indexed(shard_words),
        f"ids array<{kind}>, n_words array<long>, terms binary, counts binary, steps binary")
    return stage(
        shards.withColumn("shard", F.monotonically_increasing_id()), name,
        compression="zstd", **{"parquet.block.size": str(16 << 20)})


class _Shard:
    """Postings of a shard: term t stands at `at[begin[t]: begin[t + 1]]`, ascending."""

    def __init__(self, row: dict) -> None:
        self.first = np.cumsum([0, *row["n_words"]])
        self.terms = unascending(row["terms"], U)
        self.counts = unplaned(row["counts"], np.uint32).astype(np.int64)
        self.begin = np.append(0, np.cumsum(self.counts))
        total = np.cumsum(unplaned(row["steps"], np.uint32), dtype=np.int64)
        base = np.append(0, total)[self.begin[:-1]]
        self.at = total - np.repeat(base, self.counts)
        self.key = np.repeat(np.arange(len(self.terms)) << 32, self.counts) + self.at

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each term in this shard; -1 where it has none."""
        place = np.searchsorted(self.terms, hashes)
        there = np.flatnonzero(place < len(self.terms))
        found = np.full(len(hashes), -1)
        same = there[self.terms[place[there]] == hashes[there]]
        found[same] = place[same]
        return found

    def stands(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether term `rank` stands at `at`, for each pair."""
        key = (rank << 32) + at
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[place] == key

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


@dataclass
class _Queries:
    """A block of queries: their ids, the hashes of their distinct terms, and phrases by length, each a
    matrix of term numbers with the query that a row belongs to."""

    ids: list
    terms: np.ndarray
    phrases: list[tuple[np.ndarray, np.ndarray]]


def _phrases(rows: list, window: int) -> _Queries:
    words = words_of(pa.array([r["text"] for r in rows], pa.string()), LETTERED, lower=True)
    terms, number = np.unique(words.hashes(), return_inverse=True)
    by_length: dict[int, list] = {}
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        n = min(window, b - a)
        if n:
            own = np.unique(np.lib.stride_tricks.sliding_window_view(number[a:b], n), axis=0)
            by_length.setdefault(n, []).append((own, np.full(len(own), i)))
    return _Queries(
        [r["id"] for r in rows], terms,
        [(np.concatenate([m for m, _ in v]), np.concatenate([i for _, i in v])) for v in by_length.values()])


def _found_phrases(shard: _Shard, queries: _Queries) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(query, start, length) of every occurrence of a phrase within one document."""
    rank = shard.rank(queries.terms)
    count = np.where(rank >= 0, shard.counts[rank] if len(shard.counts) else 0, 0)
    for phrase, query in queries.phrases:
        here = np.flatnonzero((count[phrase] > 0).all(axis=1))
        if not len(here):
            continue
        phrase, query = rank[phrase[here]], query[here]
        by_rarity = np.argsort(shard.counts[phrase], axis=1, kind="stable")
        length = phrase.shape[1]
        number = shard.counts[np.take_along_axis(phrase, by_rarity[:, :1], 1)[:, 0]]
        group = np.cumsum(number) // CANDIDATES
        for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(group)) + 1):
            row = np.repeat(part, number[part])
            offset = by_rarity[row, 0]
            nth = np.arange(len(row)) - np.repeat(np.cumsum(number[part]) - number[part], number[part])
            start = shard.at[shard.begin[phrase[row, offset]] + nth] - offset
            keep = (start >= 0) & (start + length <= shard.first[-1])
            row, start = row[keep], start[keep]
            for k in range(1, length):
                offset = by_rarity[row, k]
                keep = shard.stands(phrase[row, offset], start + offset)
                row, start = row[keep], start[keep]
            keep = shard.document(start) == shard.document(start + length - 1)
            yield query[row[keep]], start[keep], length


def _merged(query: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    """Overlapping or touching spans of one query in one document as one."""
    order = np.lexsort((start, doc, query))
    query, doc, start, end = query[order], doc[order], start[order], end[order]
    group = np.cumsum(np.append(True, (np.diff(query) != 0) | (np.diff(doc) != 0))[: len(query)])
    far = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.append(True, (np.diff(group) != 0) | (start[1:] > far[:-1]))[: len(query)]
    head = np.flatnonzero(new)
    return query[head], doc[head], start[head], np.maximum.reduceat(end, head) if len(head) else end


def _matches(shard_id: int, shard: _Shard, ids: list, found: list, item_type) -> pa.RecordBatch:
    query, start, end = (np.concatenate([f[i] for f in found]) for i in range(3))
    query, doc, start, end = _merged(query, shard.document(start), start, end)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), shard_id)), pa.array(doc), pa.array([ids[q] for q in query], item_type),
         pa.array(start - shard.first[doc]), pa.array(end - shard.first[doc])],
        ["shard", "place", "item_id", "first_word", "end_word"])


def _probe(search, block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, item_type = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_buffer() for c in ("terms", "counts", "steps")}
                row["n_words"] = batch["n_words"][i].values.to_numpy()
                shard = _Shard(row)
                found = [(q, s, e) for q, s, e in search(shard, queries) if len(q)]
                if found:
                    yield _matches(batch["shard"][i].as_py(), shard, queries.ids, found, item_type)
    return run


def _phrase_search(shard: _Shard, queries: _Queries):
    return ((q, s, s + n) for q, s, n in _found_phrases(shard, queries))


def _searched(index: DataFrame, items: DataFrame, id_col: str, text_col: str, prepare, search) -> DataFrame:
    """Runs a search for all items, a block of bounded text at a time, over all shards."""
    spark = index.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = size // BLOCK_BYTES + 1
    schema = f"shard long, place long, item_id {kind}, first_word long, end_word long"
    item_type = spark.createDataFrame([], f"id {kind}").toArrow().schema.field("id").type
    out = None
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()
        sent = spark.sparkContext.broadcast((prepare(part), item_type))
        found = index.select("shard", "n_words", "terms", "counts", "steps").mapInArrow(_probe(search, sent), schema)
        out = found if out is None else out.unionByName(found)
    return out


def phrase_matches(
    index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = 10,
) -> DataFrame:
    """(shard, place, item_id, first_word, end_word): spans of documents that hold `window` consecutive
    words of an item, one after the other; overlapping ones as one. An item of fewer words is one
    phrase; null, empty and wordless items match nothing. Items may repeat."""
    return _searched(index, items, id_col, text_col, lambda rows: _phrases(rows, window), _phrase_search)


def _bags(rows: list) -> _Queries:
    words = words_of(pa.array([r["text"] for r in rows], pa.string()), LETTERED, lower=True)
    terms, number = np.unique(words.hashes(), return_inverse=True)
    bags = [np.unique(number[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    return _Queries([r["id"] for r in rows], terms, [(b, np.array([i])) for i, b in enumerate(bags) if len(b)])


def _near_search(within: int):
    def search(shard: _Shard, queries: _Queries):
        rank = shard.rank(queries.terms)
        for bag, query in queries.phrases:
            own = rank[bag]
            if (own < 0).any():
                continue
            own = own[np.argsort(shard.counts[own], kind="stable")]
            lists = [shard.at[shard.begin[t]: shard.begin[t + 1]] for t in own]
            rare = lists[0]
            near = []  # every place of any term that may open a span around a place of the rarest
            for at in lists:
                low = np.searchsorted(rare, at)
                nxt = rare[np.minimum(low, len(rare) - 1)]
                near.append(at[(nxt >= at) & (nxt - at < within)])
            start = np.unique(np.concatenate(near))
            end = start
            for at in lists:
                place = np.searchsorted(at, start)
                ok = place < len(at)
                start, end, place = start[ok], end[ok], place[ok]
                end = np.maximum(end, at[place])
            ok = (end - start < within) & (shard.document(start) == shard.document(end))
            yield np.full(int(ok.sum()), query[0]), start[ok], end[ok] + 1
    return search


def proximity_matches(
    index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, within: int = 20,
) -> DataFrame:
    """(shard, place, item_id, first_word, end_word): spans of at most `within` words of a document that
    hold every distinct word of an item, in any order; overlapping or touching spans as one."""
    return _searched(index, items, id_col, text_col, _bags, _near_search(within))


def indexed_documents(index: DataFrame) -> DataFrame:
    """(shard, place, id, n_words) of every document of the index."""
    return (
        index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "doc"))
        .select("shard", F.col("place").cast("long").alias("place"), F.col("doc.ids").alias("id"),
                F.col("doc.n_words").alias("n_words")))


def contamination(
    docs: DataFrame, items: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", *, window: int = 10,
) -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit (words inside an occurrence of a phrase of any
    item), items (sorted ids of the items found, as strings; null as the empty one), contaminated.

    Documents without words and an empty items table have no hits. Rows that repeat an id are
    judged each by its own text. An item that repeats counts once.
    """
    index = build_index(docs, stage, id_col, text_col)
    found = stage(phrase_matches(index, items, item_id_col, item_text_col, window=window), "matches")
    before = (
        Window.partitionBy("shard", "place").orderBy("first_word", "end_word")
        .rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("end_word") - F.greatest(F.col("first_word"), F.coalesce(F.max("end_word").over(before), F.lit(0)))
    hits = (
        found.withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy("shard", "place")
        .agg(F.sum("fresh").alias("n_hit"),
             F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")))
    none = F.array().cast("array<string>")
    return (
        indexed_documents(index).join(hits, ["shard", "place"], "left")
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
