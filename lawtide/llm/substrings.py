"""Passages repeated across documents, by level-wise doubling.

All windows of half the asked length are looked up in the corpus once. Only windows that repeat, in
two or more documents, are extended: a window of the asked length is a candidate if the half it begins
with and the half it ends with both repeat (of an odd length the halves share their middle word), and
one of 2n words if both its halves repeat at n. Its hash comes from theirs, so later levels read no
text, and each level sends only what the one before left, until no candidate survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawtide.llm.bundles import (
    REQUEST, answer, answers, bundled, first_bits, grown, met, part_bits, request, shrunk, written)
from lawtide.llm.packing import planes, unplaned
from lawtide.llm.words import SPACED, U, Words, mixed, windows, words_of
from lawtide.sources.workspace import Stage

#: What an entry is told: another bundle has the key in a document of a smaller id; in any document.
SMALLER, ELSEWHERE = 1, 2
#: A null id comes after all others.
LAST = np.iinfo(np.int64).max


def _told(values: np.ndarray, group: np.ndarray, begin: np.ndarray) -> np.ndarray:
    smaller = values > np.minimum.reduceat(values, begin)[group]
    elsewhere = (np.diff(np.append(begin, len(values))) > 1)[group]
    return smaller * np.int8(SMALLER) + elsewhere * np.int8(ELSEWHERE)


def _ids(cell: pa.Scalar) -> np.ndarray:
    return np.array([LAST if x is None else x for x in cell.as_py()], np.int64)


class _Keyed:
    """Windows of a bundle: their keys, the documents they are in, and per distinct key the smallest
    id and whether two documents of the bundle have it."""

    def __init__(self, keys: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> None:
        owner = ids[doc]
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.distinct = keys[begin]
        self.least = np.minimum.reduceat(owner, begin) if len(begin) else owner
        most = np.maximum.reduceat(owner, begin) if len(begin) else owner
        self.shared = most > self.least
        self.number = np.empty(len(keys), np.int64)
        self.number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
        self.owner = ids[doc]

    def repeated(self, told: np.ndarray) -> np.ndarray:
        return ((told & ELSEWHERE > 0) | self.shared)[self.number]

    def later(self, told: np.ndarray) -> np.ndarray:
        """Windows that a document of a smaller id has too."""
        return (told & SMALLER > 0)[self.number] | (self.least[self.number] < self.owner)


def _of_texts(batch: pa.RecordBatch, i: int, n: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    words = words_of(batch["texts"][i].values, SPACED, lower=False)
    keys, at = windows(words.hashes(), words.first, n)
    return words, keys, at, np.searchsorted(words.first, at, "right") - 1


def _asked(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, keys, _, doc = _of_texts(batch, i, n)
                own = _Keyed(keys, doc, _ids(batch["ids"][i]))
                yield request(batch["bundle"][i].as_py(), own.distinct, own.least, bits)
    return run


def _marks(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words are within n words from one of the starts."""
    step = np.zeros(size + 1, np.int32)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step[:-1]) > 0


def _packed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([shrunk(planes(c.astype(np.int64)))], pa.binary()) for c in columns]


def _unpacked(row: pa.Table, *columns: str) -> list[np.ndarray]:
    return [unplaned(grown(row[c][0].as_buffer()), np.int64) for c in columns]


_JUDGED = "bundle long, starts binary, repeats binary"


def _judged(state: pa.Table, said: pa.Table) -> pa.Table:
    """Where the windows of a bundle begin that a smaller id has too, and which documents have one that repeats."""
    ids, doc, at, keys = _opened(state)
    own, told = _Keyed(keys, doc, ids), answer(said)
    return pa.table(
        [state["bundle"], *_packed(at[own.later(told)], np.unique(doc[own.repeated(told)]))],
        ["bundle", "starts", "repeats"])


def _removed(n: int):
    def run(bundle: pa.Table, judged: pa.Table) -> pa.Table:
        words = words_of(bundle["texts"][0].values, SPACED, lower=False)
        repeats = np.zeros(len(bundle["ids"][0]), bool)
        starts = np.zeros(0, np.int64)
        if judged.num_rows:  # else no window of the bundle is a candidate
            starts, docs = _unpacked(judged, "starts", "repeats")
            repeats[docs] = True
        gone = _marks(starts, n, len(words.start))
        data, out = words.data.tobytes(), []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            cut = gone[a:b]
            edge = np.flatnonzero(np.diff(cut, prepend=False, append=False)).reshape(-1, 2)
            kept = b" ".join(
                [data[i:j] for i, j in zip(words.start[a:b][~cut].tolist(), words.end[a:b][~cut].tolist())])
            out.append((b - a, int(cut.sum()), edge, kept))
        spans = np.concatenate([e for _, _, e, _ in out]) if out else np.zeros((0, 2), np.int64)
        return pa.table(
            [pa.array(np.full(len(out), bundle["bundle"][0].as_py()), pa.int64()),
             pa.array(np.arange(len(out))), bundle["ids"][0].values,
             pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             pa.ListArray.from_arrays(
                 pa.array(np.cumsum([0, *(len(o[2]) for o in out)]), pa.int32()),
                 pa.StructArray.from_arrays(
                     [pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())],
                     ["start", "end"])),
             pa.array([o[3].decode("utf-8", "replace") for o in out], pa.string()), pa.array(repeats)],
            ["bundle", "place", "id", "n_words", "n_removed", "removed", "kept", "repeats"])
    return run


_STATE = "bundle long, owners binary, docs binary, at binary, keys binary, candidates long"


def _state(bundle: int, ids: np.ndarray, doc: np.ndarray, at: np.ndarray, keys: np.ndarray,
           repeated: np.ndarray, step: int) -> pa.Table:
    """Candidates that are `step` words longer: places whose window repeats, as does the one so many words on."""
    doc, at, keys = doc[repeated], at[repeated], keys[repeated]
    ahead = np.searchsorted(at, at + step)
    there = np.flatnonzero(ahead < len(at))
    there = there[(at[ahead[there]] == at[there] + step) & (doc[ahead[there]] == doc[there])]
    longer = mixed(keys[there] * U(0x9E3779B97F4A7C15) + keys[ahead[there]])
    return pa.table(
        [pa.array([bundle], pa.int64()), *_packed(ids, doc[there], at[there], longer.view(np.int64)),
         pa.array([len(there)], pa.int64())],
        ["bundle", "owners", "docs", "at", "keys", "candidates"])


def _first_state(n: int, step: int):
    def run(bundle: pa.Table, said: pa.Table) -> pa.Table:
        ids = _ids(bundle["ids"][0])
        _, keys, at, doc = _of_texts(bundle, 0, n)
        repeated = _Keyed(keys, doc, ids).repeated(answer(said))
        return _state(bundle["bundle"][0].as_py(), ids, doc, at, keys, repeated, step)
    return run


def _opened(state: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, doc, at, keys = _unpacked(state, "owners", "docs", "at", "keys")
    return ids, doc, at, keys.view(U)


def _asked_again(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, doc, _, keys = _opened(batch.slice(i, 1))
                own = _Keyed(keys, doc, ids)
                yield request(batch["bundle"][i].as_py(), own.distinct, own.least, bits)
    return run


def _next_state(n: int):
    def run(state: pa.Table, said: pa.Table) -> pa.Table:
        ids, doc, at, keys = _opened(state)
        repeated = _Keyed(keys, doc, ids).repeated(answer(said))
        return _state(state["bundle"][0].as_py(), ids, doc, at, keys, repeated, n)
    return run


def _reached(state: pa.Table, said: pa.Table) -> pa.Table:
    """Documents that still have a repeated window: those of the answered candidates."""
    ids, doc, _, keys = _opened(state)
    own = np.unique(doc[_Keyed(keys, doc, ids).repeated(answer(said))])
    return pa.table({"bundle": pa.array(np.full(len(own), state["bundle"][0].as_py()), pa.int64()), "place": pa.array(own)})


def repeated_passages(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *, words: int = 13,
    longest: bool = True,
) -> DataFrame:
    """One row per row of docs: the id, n_words, n_removed, removed (spans of words), kept (the other
    words, joined by one space), longest.

    A word is removed if a window of `words` words that covers it also starts in a document of a smaller
    id. longest: the greatest of words, 2 * words, 4 * words, ... at which some window of the document is
    also in a document of another id; 0 if none is. With `longest=False` there is no such column, and no
    level beyond `words`, which decides what is removed.

    Words are runs without white space, unchanged. null and blank texts and those of fewer than `words`
    words have nothing removed. Rows that share an id are one document for the comparison: none is
    smaller than another. Ids are integers; a null id comes after all others, so texts shared with a
    row without an id stay with the row that has one. Other columns are not read.
    """
    bundles = bundled(docs, stage, id_col, text_col)
    size = bundles.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    texts = bundles.select("bundle", "ids", "texts")
    half = (words + 1) // 2
    bits = part_bits(size // 6)
    found = answers(texts.mapInArrow(_asked(half, first_bits(bits)), REQUEST), stage, "halves", _told, bits)
    state = written(
        met(texts, found, _first_state(half, words - half), _STATE).where("candidates > 0"), stage, "state_0")
    stage.drop("halves_said")

    def said_to(state: DataFrame, level: int) -> DataFrame:
        """What the corpus says to the candidates."""
        open_ = state.agg(F.sum("candidates").alias("n")).first()["n"] or 0
        bits = part_bits(open_)
        return answers(state.mapInArrow(_asked_again(first_bits(bits)), REQUEST), stage, f"level_{level}", _told, bits)

    said = said_to(state, 0)
    judged = written(met(state, said, _judged, _JUDGED), stage, "judged")
    cut = met(
        texts, judged, _removed(words),
        f"bundle long, place long, id {docs.schema[id_col].dataType.simpleString()}, n_words long, "
        "n_removed long, removed array<struct<start: long, end: long>>, kept string, repeats boolean")
    columns = [F.col("id").alias(id_col), "n_words", "n_removed", "removed", "kept"]
    if not longest:
        stage.drop("state_0", "level_0_said")
        return cut.select(*columns)

    n, level, reached = words, 0, []
    while True:
        level += 1
        longer = written(met(state, said, _next_state(n), _STATE).where("candidates > 0"), stage, f"state_{level}")
        stage.drop(f"state_{level - 1}", f"level_{level - 1}_said")
        if longer.isEmpty():
            break
        n, state, said = 2 * n, longer, said_to(longer, level)
        reached.append(
            stage(met(state, said, _reached, "bundle long, place long"), f"reached_{level}").withColumn("n", F.lit(n)))
    if not reached:
        far = F.lit(None).cast("int")
    else:
        every = reached[0]
        for one in reached[1:]:
            every = every.unionByName(one)
        every = stage(every.groupBy("bundle", "place").agg(F.max("n").alias("longest")), "longest")
        cut, far = cut.join(every, ["bundle", "place"], "left"), F.col("longest")
    return cut.select(
        *columns, F.coalesce(far, F.when(F.col("repeats"), words).otherwise(0)).cast("long").alias("longest"))
