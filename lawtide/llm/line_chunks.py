"""Line dedup with content-defined chunks of lines, grown to whole repeated runs.

A rolling hash over the hashes of two neighbouring lines puts a boundary where it is smaller than those on both
sides of it. So boundaries depend on the few lines around them and a passage is cut alike wherever it
stands. Chunks that occur more than once in the corpus are removed from all places but the first, after
their bytes have been compared once per chunk.

A repeated run mostly begins and ends within chunks, and a short one holds none. So matches are grown by
pairs of neighbouring lines: those that no removed chunk holds are looked up in the same way, and the later
ones of equal pairs go too. A run is the union of its pairs, so all of it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawtide.functions.binding import let
from lawtide.llm.words import U, places, slices, spans, words_of
from lawtide.sources.workspace import Stage

#: Lines are all bytes but the line feed; a line of no byte belongs to the line before it.
_IN_LINE = np.arange(256) != 10


def _listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def chunk_edges(hashes: np.ndarray, first: np.ndarray, reach: int = 1) -> np.ndarray:
    """Where chunks begin, as line numbers, with the number of lines at the end.

    A chunk begins between two lines whose pair hash is smaller than the `reach` pair hashes before it
    and none greater than the `reach` after it, all within the text.
    """
    at = places(first, 2)
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    if len(at):
        value = np.full(len(hashes) + 2 * reach, 0, U)
        value[reach + at] = spans(hashes, at, 2)
        low = np.ones(len(at), bool)
        for k in range(1, reach + 1):
            # Where there is no pair the value is 0: no boundary is so near to an end of the text.
            low &= (value[reach + at] < value[reach + at - k]) & (value[reach + at] <= value[reach + at + k])
        edge[at[low] + 1] = True
    return np.flatnonzero(edge)


def _lined(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the hashes of its pairs of lines and of its chunks, the first lines of the chunks with
        the number of lines at the end, and where its lines start and end, in bytes."""
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                lines = words_of(part["text"], _IN_LINE, lower=False)
                hashes, first = lines.hashes(), lines.first
                size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in part["text"]])
                origin = np.repeat(np.append(0, np.cumsum(size))[:-1], lines.counts)
                keys = spans(hashes, places(first, 2), 2).view(np.int64)
                edges = chunk_edges(hashes, first, reach)
                begin, after = edges[:-1], edges[1:]
                chunk = np.empty(len(begin), U)
                for n in np.unique(after - begin):
                    same = after - begin == n
                    chunk[same] = spans(hashes, begin[same], int(n))
                count = np.searchsorted(begin, first[1:]) - np.searchsorted(begin, first[:-1])
                heads = np.insert(begin, np.cumsum(count), first[1:]) - np.repeat(first[:-1], count + 1)
                yield pa.RecordBatch.from_arrays(
                    [part["row"], pa.array(lines.counts, pa.int64()),
                     _listed(keys, np.maximum(lines.counts - 1, 0), pa.int64()),
                     _listed(chunk.view(np.int64), count, pa.int64()), _listed(heads, count + 1, pa.int32()),
                     _listed(lines.start - origin, lines.counts, pa.int32()),
                     _listed(lines.end - origin, lines.counts, pa.int32())],
                    ["row", "n_lines", "keys", "chunks", "heads", "starts", "ends"])
    return run


def _read(docs: DataFrame, stage: Stage, id_col: str, text_col: str, reach: int) -> DataFrame:
    """A row per row of docs with its lines and chunks; place: its number; rank: what decides which of equal
    texts comes first, by id, then by the text itself."""
    text, id_ = F.col(f"row.`{text_col}`").cast("string"), F.col(f"row.`{id_col}`")
    source = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    lists = {"keys": "array<long>", "chunks": "array<long>", "heads": "array<int>", "starts": "array<int>", "ends": "array<int>"}
    schema = source.select("row").withColumns({
        "n_lines": F.lit(0).cast("long"), **{c: F.lit(None).cast(t) for c, t in lists.items()}}).schema
    read = stage(
        source.mapInArrow(_lined(reach), schema).withColumn("place", F.monotonically_increasing_id()),
        "lined", compression="zstd")
    return read.withColumns({
        "text": text, "rank": F.struct(id_.isNull().alias("without"), id_.alias("id"), F.xxhash64(text).alias("hash"))})


def _repeated(read: DataFrame, each: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Of pieces (place, nth, key, from, to: first and last line) those that stand at an earlier place that shares
    no line with them, told by their bytes: (place, from, to)."""
    keys = stage(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), f"{name}_keys")
    # Merged at any size: a plan that broadcasts small sides grows faster than its input.
    asked = stage(
        each.join(keys.hint("merge"), "key", "left_semi").groupBy("place")
        .agg(F.collect_list(F.struct("nth", "key", "from", "to")).alias("pieces")), f"{name}_asked")

    def line(binary, i):
        return F.substring(binary, F.get("starts", i) + 1, F.get("ends", i) - F.get("starts", i))

    def with_bytes(binary, piece):
        lines = F.transform(F.sequence(piece["from"], piece["to"]), lambda i: line(binary, i).cast("string"))
        return F.struct(piece["nth"], piece["key"], piece["from"], piece["to"], F.array_join(lines, "\n").alias("bytes"))

    alike = stage(
        read.select("place", "rank", "text", "starts", "ends").join(asked.hint("merge"), "place")
        .select("place", "rank", F.explode(let(
            F.col("text").cast("binary"), lambda b: F.transform("pieces", lambda p: with_bytes(b, p)))).alias("piece"))
        .select("place", "rank", "piece.*"), f"{name}_alike", compression="zstd")
    order = F.struct("rank", "place", "from", "to")
    groups = stage(
        alike.groupBy("key", "bytes").agg(F.min(order).alias("stays"), F.count("*").alias("n")).where("n > 1")
        .select("key", "bytes", F.col("stays.place").alias("stays"), F.col("stays.to").alias("last")),
        f"{name}_groups", compression="zstd")
    return alike.join(groups.hint("merge"), ["key", "bytes"]).where("place != stays OR from > last").select(
        "place", "from", "to")


def _chunks(read: DataFrame, stage: Stage) -> DataFrame:
    """Chunks of two lines or more that stand at an earlier place: (place, from, to)."""
    each = read.select("place", "heads", F.posexplode("chunks").alias("nth", "key")).select(
        "place", "nth", "key", F.get("heads", F.col("nth")).alias("from"), (F.get("heads", F.col("nth") + 1) - 1).alias("to"))
    return _repeated(read, each.where(F.col("to") > F.col("from")), stage, "chunk")


def chunk_dedup(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *, reach: int = 1,
) -> DataFrame:
    """`line_dedup` without the growth: of equal chunks of two lines or more the first one stays."""
    read = _read(docs, stage, id_col, text_col, reach)
    return _without(read, stage(_chunks(read, stage), "gone_chunks"), stage)


def line_dedup(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *, reach: int = 1,
) -> DataFrame:
    """All rows and columns of docs as the column `row`, with text (what is left), n_lines, n_removed.

    n_lines counts lines of one byte or more; n_removed those removed. A line goes if it and a neighbour
    stand, in this order, at an earlier place that shares no line with them; the first place of every
    line stays. Earlier is the smaller (id, hash of the text, place), a null id after all others; rows of
    one id and one text are told apart by the order in which they were read. Lines are compared by their
    bytes; blank lines between them do not matter and go with the line they follow; a text that
    loses its last line ends with the last line left. null text stays null, the empty text empty; a text
    of one line is kept. Any other columns are carried along unread, inside `row`.
    """
    read = _read(docs, stage, id_col, text_col, reach)
    chunks = stage(_chunks(read, stage), "gone_chunks")
    # Pairs within a removed chunk stand at an earlier place with it: they need no lookup, and as none of
    # them is the first of its kind, no other pair needs them.
    each = (
        read.select("place", F.posexplode("keys").alias("nth", "key"))
        .join(chunks.select("place", F.explode(F.sequence("from", F.col("to") - 1)).alias("nth")), ["place", "nth"], "left_anti")
        .select("place", "nth", "key", F.col("nth").alias("from"), (F.col("nth") + 1).alias("to")))
    return _without(read, chunks.unionByName(_repeated(read, each, stage, "pair")), stage)


def _without(read: DataFrame, gone: DataFrame, stage: Stage) -> DataFrame:
    """The texts without the lines of gone (place, from, to)."""
    removed = stage(
        gone.groupBy("place").agg(F.array_sort(F.array_distinct(F.flatten(
            F.collect_list(F.sequence("from", "to"))))).alias("removed")), "removed")

    # What is left lies between removed lines: from the line after one to the start of the next.
    begin = lambda i: F.when(i == 0, 0).when(i == F.col("n_lines"), F.octet_length("text")).otherwise(F.get("starts", i))
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), "removed").alias("before"),
        F.concat("removed", F.array(F.col("n_lines").cast("int"))).alias("to"))
    left = F.filter(gaps, lambda g: g["before"] + 1 < g["to"])
    kept = let(F.col("text").cast("binary"), lambda b: F.array_join(F.transform(left, lambda g: F.substring(
        b, begin(g["before"] + 1) + 1, begin(g["to"]) - begin(g["before"] + 1)).cast("string")), ""))
    cut = F.col("removed").isNotNull()
    return read.join(removed.hint("merge"), "place", "left").select(
        "row", F.when(cut, F.rtrim(kept, F.lit("\n"))).otherwise(F.col("text")).alias("text"), "n_lines",
        F.when(cut, F.size("removed")).otherwise(0).cast("long").alias("n_removed"))
