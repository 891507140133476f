"""Looking up the keys of all documents in the whole corpus, in packed form.

n-grams of a corpus are as many as its words, too many to be a row each. Here a bundle is a row that
holds some hundred documents whole. A bundle sends its distinct keys, sorted, with a number for each,
cut by the leading bits of the key into parts; a part meets in one group, is resolved there, and every
bundle gets an answer for each of its keys, in the order it sent them. A key that is in every document
is one entry per bundle, so bundles are the partial aggregation that takes the heat from hot keys. Parts
are as many as the corpus asks for, so that each holds about the same number of keys. Where they are too
many to cut every bundle into all of them, keys are exchanged in two steps: bundles are cut into coarse
parts, crews of bundles join what they have of a coarse part, and cut that into fine ones.

Bundles are written before they are used, so keys and answers of a bundle belong together however
often tasks run again. A task holds one bundle or one part at a time, besides what Spark sorts: rows of
megabytes go to Python in small batches, and a bundle meets its answers as a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawtide.llm.packing import ascending, planes, unascending, unplaned
from lawtide.llm.words import U, slices
from lawtide.sources.workspace import Stage, small_batches

#: Text of a bundle, and keys of a part, more or less. A longer document makes a longer bundle.
BUNDLE_BYTES, PART_KEYS = 3 << 20, 2 << 20

#: Leading bits by which a bundle is cut at once; more are halved into two steps, which hold the keys on disk three times over.
ONE_STEP = 11

#: Rows handed to Python at once.
BATCH_BYTES = 4 << 20

#: Row groups are read whole, and their size is looked at every hundred rows unless told: here a few rows fill one.
PACKED = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0

    def packed() -> pa.RecordBatch:
        one, two = pa.concat_arrays(ids), pa.concat_arrays(texts)
        edge = pa.array([0, len(one)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(edge, one), pa.ListArray.from_arrays(edge, two),
             pa.array([held], pa.int64())], ["ids", "texts", "n_bytes"])

    for batch in batches:
        for a, b in slices(batch["text"], BUNDLE_BYTES // 8):
            ids.append(batch["id"].slice(a, b - a))
            texts.append(batch["text"].slice(a, b - a))
            held += texts[-1].nbytes
            if held >= BUNDLE_BYTES:
                yield packed()
                ids, texts, held = [], [], 0
    if ids:
        yield packed()


def written(df: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Tables with rows of up to some megabytes."""
    with small_batches(stage.spark, BATCH_BYTES):
        return stage(df, name, **PACKED)


def bundled(docs: DataFrame, stage: Stage, id_col: str, text_col: str) -> DataFrame:
    """(bundle, ids, texts, n_bytes), written: every row of docs is in one bundle, text and all."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_bundled, f"ids array<{kind}>, texts array<string>, n_bytes long")
    return written(made.withColumn("bundle", F.monotonically_increasing_id()), stage, "bundles")


def shrunk(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def grown(cell) -> bytes:
    cell = memoryview(cell)
    return pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True)


def part_bits(n_keys: int) -> int:
    """How many leading bits of a key name its part."""
    return max(0, (max(1, n_keys) // PART_KEYS).bit_length())


def first_bits(bits: int) -> int:
    """How many of the bits a bundle is cut by itself."""
    return bits if bits <= ONE_STEP else (bits + 1) // 2


def request(bundle: int, keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (part, bundle, keys, values) of a bundle's sorted keys, cut by the leading bits."""
    first, last = (int(keys[i]) >> (64 - bits) if len(keys) else 0 for i in (0, -1))
    cuts = np.arange(first + 1, last + 1, dtype=U) << U(64 - bits) if bits else np.zeros(0, U)
    edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:]), first) if a < b]
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _, _ in rows], pa.int64()), pa.array([bundle] * len(rows), pa.int64()),
         pa.array([shrunk(ascending(keys[a:b])) for _, a, b in rows], pa.binary()),
         pa.array([shrunk(planes(values[a:b])) for _, a, b in rows], pa.binary())],
        ["part", "bundle", "keys", "values"])


REQUEST = "part long, bundle long, keys binary, values binary"


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys and values of a part's rows, and where those of each row begin."""
    edges = np.cumsum([0, *(int.from_bytes(memoryview(c.as_buffer())[:8], "little") // 8 for c in rows["keys"])])
    keys, values = np.empty(edges[-1], U), np.empty(edges[-1], np.int64)
    for a, b, key, value in zip(edges, edges[1:], rows["keys"], rows["values"]):
        keys[a:b] = unascending(grown(key.as_buffer()), U)
        values[a:b] = unplaned(grown(value.as_buffer()), np.int64)
    return keys, values, edges


def _joined(bits: int):
    """What a crew has of a coarse part, as one list of keys in order, cut into fine parts."""
    def run(rows: pa.Table) -> pa.Table:
        keys, values, _ = _entries(rows.sort_by("bundle"))
        order = np.argsort(keys, kind="stable")
        return pa.Table.from_batches([request(rows["crew"][0].as_py(), keys[order], values[order], bits)])
    return run


def _handed_out(asked: pa.Table, said: pa.Table) -> pa.Table:
    """The answers to a crew, in the order of each bundle's keys."""
    rows = asked.sort_by("bundle")
    keys, _, edges = _entries(rows)
    told = np.empty(len(keys), np.int64)
    told[np.argsort(keys, kind="stable")] = np.concatenate(
        [unplaned(grown(c.as_buffer()), np.int64) for c in said.sort_by("part")["cell"]])
    return pa.table({
        "part": rows["part"], "bundle": rows["bundle"],
        "cell": pa.array([shrunk(planes(told[a:b])) for a, b in zip(edges, edges[1:])], pa.binary())})


def _in_two_steps(requests: DataFrame, stage: Stage, name: str, resolve: Callable, bits: int) -> DataFrame:
    coarse = first_bits(bits)
    asked = written(requests, stage, f"{name}_asked")
    crews = (asked.agg(F.countDistinct("bundle").alias("n")).first()["n"] >> coarse) + 1
    asked = asked.withColumn("crew", F.pmod(F.xxhash64("bundle"), F.lit(crews)))
    fine = asked.groupBy("part", "crew").applyInArrow(_joined(bits), REQUEST)
    said = written(_resolved(fine, resolve), stage, f"{name}_fine")
    mine = said.withColumnRenamed("bundle", "crew").withColumn(
        "coarse", F.shiftright("part", bits - coarse))
    return asked.groupBy("part", "crew").cogroup(mine.groupBy("coarse", "crew")).applyInArrow(
        _handed_out, "part long, bundle long, cell binary")


def answers(requests: DataFrame, stage: Stage, name: str, resolve: Callable, bits: int) -> DataFrame:
    """(part, bundle, cell), written: what `resolve` says to each key a bundle sent, cut by `bits`.

    resolve(values, group, begin) gets the numbers of all entries of a part ordered by key, the key
    each belongs to and where each key's entries begin; it returns an integer for each entry.
    """
    if bits == first_bits(bits):
        return written(_resolved(requests, resolve), stage, f"{name}_said")
    said = written(_in_two_steps(requests, stage, name, resolve, bits), stage, f"{name}_said")
    stage.drop(f"{name}_asked", f"{name}_fine")
    return said


def resolving(resolve: Callable):
    """The answers to all rows of a part. Arrays as long as its keys are few, and go when they are used."""
    def run(rows: pa.Table) -> pa.Table:
        keys, values, edges = _entries(rows)
        order = np.argsort(keys)
        values, keys = values[order], keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        del keys
        said = np.empty(len(order), np.int64)
        said[order] = resolve(values, np.cumsum(new, dtype=np.int32) - np.int32(1), np.flatnonzero(new))
        del order, values
        return pa.table({
            "part": rows["part"], "bundle": rows["bundle"],
            "cell": pa.array([shrunk(planes(said[a:b])) for a, b in zip(edges, edges[1:])], pa.binary())})
    return run


def _resolved(requests: DataFrame, resolve: Callable) -> DataFrame:
    return requests.groupBy("part").applyInArrow(resolving(resolve), "part long, bundle long, cell binary")


def met(rows: DataFrame, others: DataFrame, run: Callable, kinds: str) -> DataFrame:
    """What run(row, others) makes of each bundle's row, a table of one, and the other rows of that bundle."""
    return rows.groupBy("bundle").cogroup(others.groupBy("bundle")).applyInArrow(run, kinds)


def answer(said: pa.Table) -> np.ndarray:
    """The answers to a bundle's keys, in the order it sent them."""
    found = [unplaned(grown(c.as_buffer()), np.int64) for c in said.sort_by("part")["cell"]]
    return np.concatenate(found) if found else np.zeros(0, np.int64)
