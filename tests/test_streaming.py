"""Streams against the batch steps."""

import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from lawtide.config import MonitorConfig
from lawtide.plans.catalog import TABLE_SCOPE
from lawtide.state import MonitorState
from lawtide.streaming.arrivals import monitor_arrivals, retry_open
from lawtide.streaming.recent import unique_in_batch, unique_in_stream

SCHEMA = "issue_id string, issue_number string, issue_date date, html string"


def land(spark, folder, n, *texts):
    rows = [(f"2026/{n}", f"2026. évi {n}. szám", date(2026, 7, n),
             "".join(f"<h2>{i}. §</h2><p>{t}</p>" for i, t in enumerate(texts, 1)))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_arrivals_are_reported_once(spark, tmp_path):
    folder, offsets = str(tmp_path / "landed"), str(tmp_path / "offsets")
    state = MonitorState(spark, str(tmp_path / "state")).create()
    land(spark, folder, 1, "A munkavállaló bére emelkedik az idén.", "Ez a bekezdés másról szól, nem érdekes.")

    def drain():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        monitor_arrivals(stream, state, offsets).awaitTermination()

    drain()
    assert [(r.issue_number, r.anchor) for r in state.reported().collect()] == [("2026. évi 1. szám", "1. §")]
    # The same issue again, with one paragraph more, and a new issue.
    land(spark, folder, 1, "A munkavállaló bére emelkedik az idén.", "A táppénz szabályai is megváltoznak most.")
    land(spark, folder, 2, "A szabadság kiadásának új rendje lép életbe.")
    drain()
    drain()
    assert sorted((r.issue_number, r.anchor) for r in state.reported().collect()) == [
        ("2026. évi 1. szám", "1. §"), ("2026. évi 1. szám", "2. §"), ("2026. évi 2. szám", "1. §")]
    assert state.total_reported() == 3 and state.run_log().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        F.col("page_id").cast("string").alias("issue_id"), F.col("url").alias("issue_number"),
        F.lit(date(2024, 1, 1)).alias("issue_date"), "html")
    pages.repartition(4).write.parquet(str(tmp_path / "landed"))
    state = MonitorState(spark, str(tmp_path / "state")).create()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    monitor_arrivals(stream, state, str(tmp_path / "offsets"), scope=TABLE_SCOPE).awaitTermination()
    assert state.run_log().count() == 4
    whole = MonitorState(spark, str(tmp_path / "whole")).create()
    one = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "landed"))
    monitor_arrivals(one, whole, str(tmp_path / "offsets_of_one"), scope=TABLE_SCOPE).awaitTermination()
    assert whole.run_log().count() == 1
    keys = ["issue_number", "anchor"]
    got = {tuple(r) for r in state.reported().select(*keys, "score").collect()}
    assert got and got == {tuple(r) for r in whole.reported().select(*keys, "score").collect()}
    assert {r.issue_id for r in state.progress().collect()} == {r.issue_id for r in whole.progress().collect()}


def test_arrivals_take_every_step_of_a_run(spark, tmp_path):
    """Model, note, page texts, failures and progress; an open issue closes when it lands again."""
    state = MonitorState(spark, str(tmp_path / "state")).create()
    folder = str(tmp_path / "landed")

    def make_scorer():
        def scorer(texts):
            return [
                RuntimeError("down") if "táppénz" in t and "megint" not in t
                else json.dumps({"is_relevant": True, "score": 0.9, "one_line_summary_hu": "jegyzet" if "INDOK" in t else "-"})
                for t in texts]
        return scorer

    texts = spark.createDataFrame(
        [("2026/3", 1, "3. § A szabadság kiadásának szabályai változnak meg.")], "issue_id string, page_no long, page_text string")
    notes = spark.createDataFrame(
        [("2026/1", "<h1>x</h1><p>INDOK: a munkavállaló védelme.</p>")], "issue_id string, html string")

    def drain():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        monitor_arrivals(
            stream, state, str(tmp_path / "offsets"), make_scorer=make_scorer, page_texts=texts,
            justifications=notes).awaitTermination()

    # No stem in the text of the first: its note makes it a candidate.
    land(spark, folder, 1, "Ez a bekezdés önmagában semmiről sem szól.")
    land(spark, folder, 2, "A táppénz szabályai is megváltoznak most.")
    rows = [("2026/3", "2026. évi 3. szám", date(2026, 7, 3), None), ("2026/4", "2026. évi 4. szám", date(2026, 7, 4), None)]
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
    drain()
    assert {(r.issue_number, r.anchor, r.one_line_summary) for r in state.reported().collect()} == {
        ("2026. évi 1. szám", "1. §", "jegyzet"), ("2026. évi 3. szám", "3. §", "-")}
    assert {(r.issue_id, r.reason) for r in state.open_issues("hr").collect()} == {
        ("2026/2", "failed"), ("2026/4", "no content")}
    assert {r.issue_id for r in state.progress().collect()} == {"2026/1", "2026/3"}
    log = state.run_log().first()
    assert (log.issues_scanned, log.failures, log.new_items, len(log.warnings)) == (4, 1, 2, 1)
    land(spark, folder, 2, "A táppénz szabályai megint megváltoznak most.")
    drain()
    assert {r.issue_id for r in state.open_issues("hr").collect()} == {"2026/4"}


def test_open_issues_are_tried_again(spark, tmp_path):
    """A failed call is repeated with the next batch, or without one; the body lands once."""
    state = MonitorState(spark, str(tmp_path / "state")).create()
    folder, up = str(tmp_path / "landed"), tmp_path / "up"

    def make_scorer():
        def scorer(texts):
            return ['{"is_relevant": true, "score": 0.9}' if up.exists() or "táppénz" not in t else RuntimeError("down") for t in texts]
        return scorer

    def drain(cfg=MonitorConfig()):
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        monitor_arrivals(stream, state, str(tmp_path / "offsets"), cfg=cfg, make_scorer=make_scorer).awaitTermination()

    def keys():
        return sorted((r.issue_number[-8:], r.anchor) for r in state.reported().collect())

    land(spark, folder, 1, "A munkavállaló bére emelkedik az idén.", "A táppénz szabályai is megváltoznak most.")
    land(spark, folder, 2, "A táppénz új összege januártól érvényes lesz.")
    drain()
    assert keys() == [(" 1. szám", "1. §")]
    assert {(r.issue_id, r.attempts) for r in state.open_issues("hr").collect()} == {("2026/1", 1), ("2026/2", 1)}
    land(spark, folder, 3, "A szabadság kiadásának új rendje lép életbe.")
    drain(MonitorConfig(retry_after=timedelta(hours=2)))
    assert {(r.issue_id, r.attempts) for r in state.open_issues("hr").collect()} == {("2026/1", 2), ("2026/2", 2)}
    up.touch()
    land(spark, folder, 4, "A szabadság kiadásának rendje megint változik.")
    drain()
    # Not due yet.
    assert state.open_issues("hr").count() == 2 and len(keys()) == 3
    later = [r.next_try for r in state.open_issues("hr").collect()]
    assert all(t > datetime.now() for t in later)


def test_open_issues_are_closed_without_a_landing(spark, tmp_path):
    state = MonitorState(spark, str(tmp_path / "state")).create()
    folder, up = str(tmp_path / "landed"), tmp_path / "up"

    def make_scorer():
        return lambda texts: [
            '{"is_relevant": true, "score": 0.9}' if up.exists() else RuntimeError("down") for _ in texts]

    land(spark, folder, 1, "A munkavállaló bére emelkedik az idén.")
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    monitor_arrivals(stream, state, str(tmp_path / "offsets"), make_scorer=make_scorer).awaitTermination()
    assert state.reported().count() == 0 and state.open_issues("hr").count() == 1
    up.touch()
    retry_open(state, "retry-1", make_scorer=make_scorer)
    assert [r.issue_number for r in state.reported().collect()] == ["2026. évi 1. szám"]
    assert state.open_issues("hr").count() == 0


def test_keys_expire_and_late_rows_are_dropped(spark, tmp_path):
    schema, folder = "id long, ts timestamp, k string", str(tmp_path / "in")
    for day_, k, n in ((1, "a", 1), (5, "a", 2), (40, "b", 3), (41, "a", 4)):
        more = [(9, datetime(2026, 1, 5), "late")] if n == 4 else []
        spark.createDataFrame([(n, datetime(2026, 1, 1) + timedelta(days=day_ - 1), k), *more], schema).coalesce(
            1).write.mode("append").parquet(folder)
        unique_in_stream(
            spark.readStream.schema(schema).parquet(folder), "ts", ["k"], "10 days",
        ).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option(
            "path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    # Row 2 repeats within the look-back; "a" was forgotten when row 4 came; "late" is behind the watermark.
    assert sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]


def test_recent_keys(spark, tmp_path):
    rows = [(1, datetime(2026, 1, 1), "a"), (2, datetime(2026, 1, 2), "a"), (3, datetime(2026, 1, 3), "b")]
    table = spark.createDataFrame(rows, "id long, ts timestamp, k string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = unique_in_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "ts", ["k"])
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option(
        "path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {r.k for r in spark.read.schema(table.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {"a", "b"}
    assert [r.id for r in unique_in_batch(table, "ts", ["k"], ["id"]).orderBy("id").collect()] == [1, 3]


def test_a_hot_key_is_combined_before_the_state(spark, tmp_path):
    """A key with half of all rows reaches the state as a few rows; the keys that come out are the same."""
    from lawtide.streaming.recent import _ends_of_keys
    schema = "id long, ts timestamp, k string, l long"
    start = datetime(2026, 1, 1)
    rows = [(i, start + timedelta(minutes=i % 977), "hot" if i % 2 else f"k{i % 50}", None if i % 3 else 1) for i in range(6000)]
    rows += [(9000, start - timedelta(days=1), "hot", 7), (9001, None, "hot", 8), (9002, None, "hot", 8)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "in"))
    table = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    sent = table.mapInArrow(_ends_of_keys("ts", ["k", "l"]), schema)
    hot = sent.where("k = 'hot' AND ts IS NOT NULL").groupBy("l").count().collect()
    assert all(r["count"] <= 2 * 4 for r in hot) and sent.where("ts IS NULL").count() == 2

    def keys(combine):
        name = str(tmp_path / f"combine-{combine}")
        unique_in_stream(
            spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["k", "l"], "10 days", combine,
        ).writeStream.format("parquet").option("checkpointLocation", name + "-c").option("path", name).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(((r.k, r.l) for r in spark.read.schema(schema).parquet(name).collect()), key=str)
    assert keys(True) == keys(False) and len(keys(True)) == len({(k, l) for _, _, k, l in rows})


def test_combining_keeps_a_row_behind_a_late_one():
    """A late row comes with one that counts: both are sent on, those between them are not."""
    import pyarrow as pa
    from lawtide.streaming.recent import _ends_of_keys
    times = [datetime(2026, 1, d) for d in (9, 1, 5)]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "ts": times, "k": ["a"] * 3})
    assert [b["id"].to_pylist() for b in _ends_of_keys("ts", ["k"])([batch])] == [[1, 2]]
    assert [b.num_rows for b in _ends_of_keys("ts", ["k"])([batch.slice(0, 0)])] == [0]
