"""Memory of the packed exchange of n-grams and windows: what a task holds does not grow with the corpus."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lawtide.llm import backoff, bundles, substrings, words
from lawtide.llm.packing import unplaned
from lawtide.sources.workspace import BATCH_BYTES, Stage


def traced_peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_are_hashed_in_blocks(monkeypatch):
    """Blocks change no hash, also where a word is longer than one, and bound what is held besides the words."""
    texts = pa.array(["a bc", None, "", "x" * 300 + " y", " the  end" * 40])
    whole = words.words_of(texts, words.SPACED, lower=False).hashes()
    for size in (1, 7, 64):
        monkeypatch.setattr(words, "HASHED_BYTES", size)
        assert np.array_equal(words.words_of(texts, words.SPACED, lower=False).hashes(), whole)
    monkeypatch.undo()
    long = words.words_of(pa.array(["some words " * 300_000]), words.SPACED, lower=False)
    assert traced_peak(long.hashes) < 8 * len(long.data)


def test_memory_of_a_part():
    """A part takes some six numbers for each of its keys, and every row gets the answers to its own."""
    n, rng = 50_000, np.random.default_rng(4)
    asked = [np.unique(rng.integers(0, 2 * n, n).astype(np.uint64)) for _ in range(4)]
    rows = pa.Table.from_batches(
        [bundles.request(i, keys, np.full(len(keys), i + 1), 0) for i, keys in enumerate(asked)])
    run = bundles.resolving(backoff._summed)
    assert traced_peak(lambda: run(rows)) < 8 * 8 * sum(map(len, asked))
    got = {r["bundle"]: unplaned(bundles.grown(r["cell"]), np.int64) for r in run(rows).to_pylist()}
    for i, keys in enumerate(asked):
        assert np.array_equal(got[i], sum((j + 1) * np.isin(keys, other) for j, other in enumerate(asked)))


def test_bundles_reach_python_one_by_one(spark, monkeypatch):
    """Rows of megabytes are not gathered to batches of 64 MB; the setting is that of the caller afterwards."""
    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    monkeypatch.setattr(bundles, "BATCH_BYTES", 1000)
    before = spark.conf.get(BATCH_BYTES)
    rows = spark.createDataFrame([(i, "some words " * 200) for i in range(20)], "bundle long, texts string").repartition(1)
    got = bundles.written(rows.mapInArrow(held, "n long"), Stage(spark), "held").collect()
    assert [r["n"] for r in got] == [1] * 20
    assert spark.conf.get(BATCH_BYTES) == before


def test_bundles_meet_their_answers_alone(spark):
    """The last step holds the texts and answers of one bundle, not those of all bundles of a batch."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    for got in (substrings.repeated_passages(docs, Stage(spark), words=2, longest=False), backoff.backoff_scores(docs, Stage(spark))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
        assert "collect_list" not in plan and got.count() == 3
