"""Each key once within a bounded look-back, on a stream and in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lawtide.operators.ordered import first_per


def unique_in_stream(
    stream: DataFrame, time: str, keys: Sequence[str], lookback: str = "30 days", combine: bool = True,
) -> DataFrame:
    """Keys are remembered for `lookback` of event time, then their state is dropped and a row of the
    key comes out again. Rows later than `lookback` behind the newest of earlier batches are dropped.

    A key is one row of state in one task. With `combine`, each task sends a few rows a key there, so a key
    that holds half of a micro-batch costs no task more than others do. Which keys come out is the same
    either way; of several rows of a key in one micro-batch, any that is not late may be the one.
    """
    if combine:
        stream = stream.mapInArrow(_ends_of_keys(time, list(keys)), stream.schema)
    return stream.withWatermark(time, lookback).dropDuplicatesWithinWatermark(list(keys))


def _ends_of_keys(time: str, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The earliest and the latest row of each key in every batch of rows, and all rows without a time.

    A late row does not count, so the earliest alone could hide a key; where the latest is late, all are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch[time])  # rows without a time come last
            dated = order.slice(0, len(order) - batch[time].null_count)
            rows = pa.table([*(batch[k].take(dated) for k in keys), dated], [*(f"k{i}" for i in range(len(keys))), "row"])
            ends = rows.group_by([f"k{i}" for i in range(len(keys))], use_threads=False).aggregate(
                [("row", "first"), ("row", "last")])
            kept = pa.chunked_array([
                *ends["row_first"].chunks, *ends["row_last"].chunks, order.slice(len(dated))], order.type)
            yield batch.take(pc.unique(kept).sort())
    return run


def unique_in_batch(
    rows: DataFrame, time: str, keys: Sequence[str], tie_break: Sequence[str] = (),
) -> DataFrame:
    """First row per key: what the stream emits while no key is older than the look-back."""
    return first_per(rows, list(keys), [time, *tie_break])
