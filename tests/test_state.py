"""The state as versions: commits, folding, readers and writers at the same time."""

import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lawtide.state import MonitorState

NOW = datetime(2026, 7, 2, 8)
ITEM = "issue_number string, issue_date date, anchor string, content_hash string, issue_id string, pos long"


def items(spark, *keys, day=date(2026, 7, 1)):
    rows = [(n, day, a, "h", n, i) for i, (n, a) in enumerate(keys)]
    df = spark.createDataFrame(rows, ITEM)
    for name, kind in (("score", "double"), ("one_line_summary", "string"), ("expansion", "string"), ("justification_url", "string"),
                       ("matched_topics", "array<string>"), ("key_dates", "array<string>"), ("action_items", "array<string>")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def report(state, run_id, *keys, day=date(2026, 7, 1)):
    n = state.mark_reported(items(state.spark, *keys, day=day), run_id, NOW)
    state.commit(state.log_row(run_id=run_id, scope="hr", run_date=NOW.date(), run_ts=NOW, persisted=n), run_id)


def keys_of(state, **cut):
    return sorted((r.run_id, r.issue_number, r.anchor) for r in state.reported(**cut).collect())


@pytest.fixture
def state(spark, tmp_path):
    return MonitorState(spark, str(tmp_path / "state")).create()


def test_runs_fold_into_one_folder_a_month(state):
    for n in range(12):
        report(state, f"r{n:02d}", (f"n{n}", "1. §"), day=date(2026, 6 + n % 2, 1 + n))
    before = keys_of(state)
    reader = state.pinned()
    version = state.compact()
    (part,) = version.parts("reported_items")
    assert part.months == ("2026-06", "2026-07") and len(version.parts("run_log")) == 1
    assert keys_of(state) == before and state.total_reported() == 12
    # The reader goes on with the folders of its version.
    assert len(reader.version.parts("reported_items")) == 12 and keys_of(reader) == before
    state.vacuum(timedelta(0))
    assert keys_of(state) == before and state.manifests.numbers() == [version.number]
    assert keys_of(state, months=["2026-06"]) == [k for k in before if int(k[0][1:]) % 2 == 0]


def test_a_folded_run_is_repeated(state):
    report(state, "r1", ("n1", "1. §"), ("n2", "1. §"))
    report(state, "r2", ("n3", "1. §"))
    state.compact()
    report(state, "r1", ("n2", "1. §"), ("n4", "1. §"))
    assert keys_of(state) == [("r1", "n2", "1. §"), ("r1", "n4", "1. §"), ("r2", "n3", "1. §")]
    assert state.run_log().count() == 2 and state.total_reported() == 3
    state.compact()
    assert keys_of(state) == [("r1", "n2", "1. §"), ("r1", "n4", "1. §"), ("r2", "n3", "1. §")]
    assert all(p.without == () for parts in state.pinned().version.tables.values() for p in parts)


def test_a_fold_that_dies_changes_nothing(state, monkeypatch):
    report(state, "r1", ("n1", "1. §"))
    report(state, "r2", ("n2", "1. §"))
    before, numbers = keys_of(state), state.manifests.numbers()

    def die(version):
        raise KeyboardInterrupt
    monkeypatch.setattr(state.manifests, "_put", die)
    with pytest.raises(KeyboardInterrupt):
        state.compact()
    monkeypatch.undo()
    assert keys_of(state) == before and state.manifests.numbers() == numbers
    state.vacuum(timedelta(0))
    assert keys_of(state) == before


def test_a_run_that_commits_during_a_fold_is_kept(state, monkeypatch):
    report(state, "r1", ("n1", "1. §"))
    report(state, "r2", ("n2", "1. §"))
    switch = state.manifests.switch
    other = MonitorState(state.spark, state.root)

    def late(change):
        monkeypatch.undo()
        report(other, "r3", ("n3", "1. §"))
        report(other, "r2", ("n4", "1. §"))
        return switch(change)
    monkeypatch.setattr(state.manifests, "switch", late)
    state.compact()
    assert keys_of(state) == [("r1", "n1", "1. §"), ("r2", "n4", "1. §"), ("r3", "n3", "1. §")]


def test_writers_at_the_same_time(state):
    """Every writer makes its change on the newest version; none is lost."""
    def commit(n):
        own = MonitorState(state.spark, state.root)
        own.commit(own.log_row(run_id=f"r{n}", scope="hr", persisted=1), f"r{n}")
    threads = [threading.Thread(target=commit, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.run_id for r in state.run_log().collect()) == [f"r{n}" for n in range(6)]


def test_items_without_date_and_number(state):
    report(state, "r1", ("n1", "1. §"), day=None)
    report(state, "r2", ("n1", "1. §"), (None, "2. §"), day=None)
    assert [(r.run_id, r.issue_number) for r in state.reported().orderBy("run_id").collect()] == [("r1", "n1"), ("r2", None)]


def test_equal_times_have_one_winner(state):
    rows = lambda n: state.spark.createDataFrame(
        [("i", date(2026, 7, 1), n, 0, NOW)],
        "issue_id string, issue_date date, items_classified long, items_relevant long, processed_at timestamp")
    for run_id, n in (("r2", 2), ("r1", 1)):
        state.mark_processed(rows(n), run_id)
        state.commit(state.log_row(run_id=run_id, scope="hr"), run_id)
    assert [r.items_classified for r in state.progress().collect()] == [2]


def test_open_issues_wait_longer_each_time(state):
    issue = state.spark.createDataFrame(
        [("i", "n", date(2026, 7, 1), False, None, None, None, "failed")],
        "issue_id string, issue_number string, issue_date date, has_justification boolean, view_url string, pdf_url string, "
        "justification_url string, reason string")
    at = NOW
    for n, wait in enumerate((10, 20, 40)):
        state.mark_open(issue, f"r{n}", at, retry_after=timedelta(minutes=10))
        state.commit(state.log_row(run_id=f"r{n}", scope="hr"), f"r{n}")
        (row,) = state.open_issues("hr").collect()
        assert (row.attempts, row.next_try) == (n + 1, at + timedelta(minutes=wait))
        assert state.open_issues("hr", due=at + timedelta(minutes=wait - 1)).count() == 0
        at += timedelta(minutes=wait)
        assert state.open_issues("hr", due=at).count() == 1
    done = issue.select("issue_id", "issue_date", F.lit(1).alias("items_classified"), F.lit(0).alias("items_relevant"),
                        F.lit(at).alias("processed_at"))
    state.mark_processed(done, "r3")
    state.commit(state.log_row(run_id="r3", scope="hr"), "r3")
    assert state.open_issues("hr").count() == 0
    # Opened again after that, it starts anew.
    state.mark_open(issue, "r4", at + timedelta(days=1))
    state.commit(state.log_row(run_id="r4", scope="hr"), "r4")
    assert [r.attempts for r in state.open_issues("hr").collect()] == [1]
