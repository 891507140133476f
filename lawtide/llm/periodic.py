"""Runs of repeated words (periodicities), found on a grammar of the word ids.

1. Re-Pair: pairs of neighbouring symbols that repeat become nonterminals, the most frequent first. A round
   counts all pairs and replaces each one that ranks above the pairs it overlaps, so one round does the
   work of many single replacements; rounds go on until no pair repeats. Documents handled together share a
   grammar; no pair crosses two documents. The start rule that is left is cut into halves, as a balanced tree.
2. A run lies in the expansion of some lowest node of that tree and crosses the boundary between its two
   children. Of a run of exponent 4 or more, two periods lie on one side of the boundary, so the periods
   tried are those whose first two copies beside it are equal; the run is then stretched to both sides
   within the expansion. Every nonterminal is searched once, at its first place.
3. What was found is moved to all places of the nonterminal. A stretch cut off by the end of an
   expansion lies within a longer one of the same period, so what no other holds are the runs.

Equality of stretches is told by 64-bit hashes and every run checked word by word; where the check
fails, the documents are searched again by comparing words at every distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawtide.llm.words import _WORDS, SPACED, U, slices, words_of

RUN = "array<struct<start:long,length:long,period:long>>"


def repaired(ids: np.ndarray, doc: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """Rules by round, and where the symbols of the start rules begin and end.

    ids: numbers from 0; doc: ascending, the document of each. A round of rules is (begin, middle, end, rule,
    place): of each rule its first expansion and the boundary in it; of each place the rule and its begin.
    """
    symbol, begin, end = ids.astype(np.int64), np.arange(len(ids)), np.arange(1, len(ids) + 1)
    inner = np.append(doc[1:] == doc[:-1], False) if len(ids) else np.zeros(0, bool)
    open_, names, rounds = inner.copy(), int(ids.max(initial=-1)) + 1, []
    while True:
        at = np.flatnonzero(open_)
        _, pair, count = np.unique(symbol[at] * names + symbol[at + 1], return_inverse=True, return_counts=True)
        open_[at] = repeats = count[pair] > 1
        at, pair = at[repeats], pair[repeats]
        if not len(at):
            return rounds, begin, end
        # The rank of the pair at each place, 0 for pairs that do not repeat. A pair of one symbol twice
        # overlaps itself: of such a stretch every other place counts.
        rank = np.zeros(len(symbol) + 2, np.int64)
        rank[at + 1] = (np.argsort(np.argsort(count, kind="stable")) + 1)[pair]
        opens = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        stretch = opens[np.searchsorted(opens, at + 1, "right") - 1]
        wins = ((at + 1 - stretch) % 2 == 0) & (rank[at + 1] >= rank[at]) & (rank[at + 1] >= rank[at + 2])
        at = at[wins]
        _, first, rule = np.unique(pair[wins], return_index=True, return_inverse=True)
        heads = at[first]
        rounds.append((begin[heads], end[heads], end[heads + 1], rule, begin[at]))
        symbol[at], end[at], inner[at] = names + rule, end[at + 1], inner[at + 1]
        names += len(first)
        open_[at] = inner[at]
        before = at[at > 0] - 1
        open_[before] = inner[before]
        left = np.ones(len(symbol), bool)
        left[at + 1] = False
        symbol, begin, end, inner, open_ = (x[left] for x in (symbol, begin, end, inner, open_))


def halves(begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes (begin, middle, end) of balanced trees over the symbols of every document, level by level."""
    while len(begin):
        own = doc[begin]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        nth = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
        two = np.flatnonzero(nth % 2 == 1)
        if not len(two):
            return
        yield begin[two - 1], end[two - 1], end[two]
        end[two - 1] = end[two]
        left = nth % 2 == 0
        begin, end = begin[left], end[left]


class Crossing:
    """Runs across given boundaries in a text of word hashes."""

    def __init__(self, hashes: np.ndarray, least: int, times: int) -> None:
        self.up, self.down = _WORDS.upto(len(hashes) + 1)
        self.hashes, self.least, self.times = hashes, least, times
        self.total = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.total[1:])

    def alike(self, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from `one` are those from `two`."""
        return ((self.total[one + n] - self.total[one]) * self.down[one]
                == (self.total[two + n] - self.total[two]) * self.down[two])

    def common(self, one: np.ndarray, two: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from `one` and `two` on (step 1) or before them (step -1)."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            back = n if step < 0 else 0
            same = self.alike(one - back, two - back, n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low

    def runs(self, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(node, start, stop, period) of periodic stretches of the nodes across their middle."""
        found = []
        for right in (True, False):
            side = end - middle if right else middle - begin
            most = np.minimum((end - begin) // self.times, side // 2)
            node = np.repeat(np.arange(len(most)), most)
            period = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
            one = middle[node] if right else middle[node] - 1
            near = self.hashes[one] == self.hashes[one + (period if right else -period)]
            node, period = node[near], period[near]
            one = middle[node] - (0 if right else 2 * period)
            square = self.alike(one, one + period, period)
            node, period, one = node[square], period[square], one[square]
            # one .. one + 2 * period is a square that ends or begins at the middle.
            stop = one + period + self.common(one, one + period, end[node] - one - period, 1)
            start = one - self.common(one, one + period, one - begin[node], -1)
            long = stop - start >= np.maximum(self.least, self.times * period)
            found.append((node[long], start[long], stop[long], period[long]))
        node, start, stop, period = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((period, stop, start, node))
        node, start, stop, period = node[order], start[order], stop[order], period[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        return node[new], start[new], stop[new], period[new]


def maximal(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches that no other of the same period holds, each with its smallest period, by start and period."""
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    wide = int(stop.max(initial=0)) + 1
    reach = stop + period * wide
    before = np.append(-1, np.maximum.accumulate(reach)[:-1]) if len(reach) else reach
    out = reach > before
    start, stop, period = start[out], stop[out], period[out]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def by_distance(ids: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """The runs of one document, from the words that agree at every distance."""
    found = [np.zeros((3, 0), np.int64)]
    for period in range(1, len(ids) // times + 1):
        same = np.concatenate(([False], ids[:-period] == ids[period:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        start, stop = edge[:, 0], edge[:, 1] + period
        long = stop - start >= max(least, times * period)
        found.append(np.stack([start[long], stop[long], np.full(int(long.sum()), period)]))
    return maximal(*np.concatenate(found, axis=1))


def runs_of(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(start, stop, period) of all runs, by start and period; document d is ids[first[d]:first[d + 1]]."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rounds, begin, end = repaired(ids, doc)
    crossing = Crossing(hashes, least, times)
    found = [(np.zeros(0, np.int64),) * 3]
    for head, middle, tail, rule, place in rounds:
        node, start, stop, period = crossing.runs(head, middle, tail)
        if len(node):
            order = np.argsort(rule, kind="stable")
            edge = np.searchsorted(rule[order], np.arange(len(head) + 1))
            times_here = np.diff(edge)[node]
            run = np.repeat(np.arange(len(node)), times_here)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(times_here) - times_here, times_here)
            moved = place[order][edge[node][run] + nth] - head[node][run]
            found.append((start[run] + moved, stop[run] + moved, period[run]))
    for node in halves(begin, end, doc):
        found.append(crossing.runs(*node)[1:])
    start, stop, period = maximal(*(np.concatenate(x) for x in zip(*found)))
    for a, b, p in zip(start.tolist(), stop.tolist(), period.tolist()):
        low, high = first[doc[a]], first[doc[a] + 1]
        if (not np.array_equal(ids[a: b - p], ids[a + p: b])
                or a > low and ids[a - 1] == ids[a - 1 + p] or b < high and ids[b] == ids[b - p]):
            parts = [by_distance(ids[x:y], least, times) for x, y in zip(first[:-1], first[1:])]
            return tuple(np.concatenate(
                [part[i] + (x if i < 2 else 0) for part, x in zip(parts, first[:-1])]) for i in range(3))
    return start, stop, period


def _searched(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                texts = batch["text"].slice(a, b - a)
                words = words_of(texts, SPACED, lower=False)
                hashes, first = words.hashes(), words.first
                ids = np.unique(hashes, return_inverse=True)[1]
                start, stop, period = runs_of(ids, hashes, first, least, times)
                edge = np.searchsorted(start, first)
                origin = np.repeat(first[:-1], np.diff(edge))
                runs = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (start - origin, stop - start, period)],
                    ["start", "length", "period"])
                # Words that a run covers beyond its first copy: more runs begin there than have ended.
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, stop, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = [
                    words.joined(keep[first[d]: first[d + 1]], d) if edge[d] < edge[d + 1]
                    else b" ".join((t.as_buffer().to_pybytes() if t.is_valid else b"").split())
                    for d, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(a, b - a), pa.array(words.counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edge, pa.int32()), runs),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 6, times: int = 4,
) -> DataFrame:
    """One row per row of docs: the id, n_words, runs, collapsed.

    Words are runs without white space, numbered from 0. runs: every stretch of words with smallest
    period p, of max(least, times * p) words or more, that cannot be extended keeping p, as (start,
    length, period), by start, then period; times is 4 or more. collapsed: the words, joined by one
    space, but for those that a run holds after its first p words.

    null, empty and blank texts: no word, no run, collapsed empty. Rows are judged one by one, so
    repeated rows and ids give repeated results; a null id stays null. Columns beyond the two
    named are not read. A text is handled whole in one task, in memory in proportion to its length.
    """
    if times < 4 or least < 1:
        raise ValueError("times is 4 or more, least 1 or more")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(
        _searched(least, times), f"id {kind}, n_words long, runs {RUN}, collapsed string"
    ).withColumnRenamed("id", id_col)
