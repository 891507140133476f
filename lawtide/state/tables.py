"""State tables on Parquet: parts that runs add, and snapshots that they are folded into.

Every attempt of a run writes folders of its own, cut by the month of the issue and, for reported items, by
a hash bucket of the issue number; what names them as the state is the manifest (:mod:`.manifest`), which
`commit` switches once, with all tables of the run and its log row together. So rows of an attempt that failed are
never seen, a run repeated under its id takes the place of what it left, and an upsert is
"append, read the latest row per key". `compact` folds all parts into one per table and month.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawtide import schemas
from lawtide.functions.text import score_text, short_summary
from lawtide.operators.dedupe import dedup_key
from lawtide.state import merge
from lawtide.state.manifest import Manifests, Part, Version

RUN_ID = T.StructField("run_id", T.StringType())
MONTH = T.StructField("issue_month", T.StringType())
BUCKET = T.StructField("key_bucket", T.IntegerType())
ANY_DATE = (date(1900, 1, 1), date(2999, 12, 31))
#: Issues without a date are in the folder that Spark gives a null.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
#: Buckets of the issue number within a month.
BUCKETS = 16


class MonitorState:
    """The state below `root`. With a `version` it stays as that version has it, whatever is committed."""

    def __init__(self, spark: SparkSession, root: str, version: Version | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.version = version
        self.manifests = Manifests(spark, f"{self.root}/manifest")
        self.schemas = {
            "reported_items": T.StructType([*schemas.REPORTED_ITEMS.fields, RUN_ID, MONTH, BUCKET]),
            "issue_progress": T.StructType([*schemas.ISSUE_PROGRESS.fields, RUN_ID, MONTH]),
            "open_issues": T.StructType([*schemas.OPEN_ISSUES.fields, RUN_ID, MONTH]),
            "open_bodies": T.StructType([*schemas.OPEN_BODIES.fields, RUN_ID, MONTH]),
            "run_log": T.StructType([*schemas.RUN_LOG.fields[1:], RUN_ID]),
        }
        self._written: dict[str, dict[str, Part]] = {}

    # -- versions --------------------------------------------------------------

    def create(self) -> MonitorState:
        """Make the first version, with empty tables, if there is none."""
        if not self.manifests.numbers():
            self.manifests.switch(lambda tables: tables or {name: () for name in self.schemas})
        return self

    def reset(self) -> MonitorState:
        """Empty all tables. Readers of an earlier version keep it until `vacuum`."""
        self.manifests.switch(lambda _: {name: () for name in self.schemas})
        return self

    def pinned(self) -> MonitorState:
        """The state as it is now, for the reads of one run; the manifest is read here alone."""
        return MonitorState(self.spark, self.root, self.version or self.manifests.current())

    def compact(self) -> Version:
        """Fold the parts of every table into one with a folder a month, and switch to it.

        Runs that commit meanwhile keep their parts, and those repeated meanwhile hide their rows in
        the snapshot. Until the switch nothing has changed; after it, `vacuum` may drop the folded folders.
        """
        seen = self.manifests.current()
        folded = {
            name: self._write(name, self._rows(seen, name), "") for name in self.schemas if len(seen.parts(name)) > 1}

        def change(tables):
            out = dict(tables)
            for name, part in folded.items():
                old = {p.name: p for p in seen.parts(name)}
                now = {p.name: p for p in tables.get(name, ())}
                replaced = {p.run_id for n, p in old.items() if n not in now and p.run_id}
                hidden = {r for n in old if n in now for r in set(now[n].without) - set(old[n].without)}
                if not now.keys() & old.keys():
                    continue  # Reset or folded by another in the meantime.
                out[name] = (
                    replace(part, without=tuple(sorted(replaced | hidden))),
                    *[p for n, p in now.items() if n not in old])
            return out
        return self.manifests.switch(change)

    def vacuum(self, older_than: timedelta = timedelta(days=1)) -> None:
        """Delete folders that the newest version does not name and that nobody has written to for so
        long, and the versions before it. Runs that last longer than that lose their reads."""
        kept = self.manifests.current()
        limit = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
        for name in self.schemas:
            folder = self.manifests._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            files = self.manifests.files(folder)
            if files.exists(folder):
                for found in files.listStatus(folder):
                    named = found.getPath().getName().removeprefix("part=") in kept.names()
                    if not named and found.getModificationTime() <= limit:
                        files.delete(found.getPath(), True)
        self.manifests.drop_before(kept.number)

    # -- reading ---------------------------------------------------------------

    def _rows(
        self, version: Version, name: str, without_run: str | Sequence[str] | None = None, scope: str | None = None,
        months: Sequence[str] | None = None, buckets: Sequence[int] | None = None,
    ) -> DataFrame:
        """Rows of a table in a version. Only folders of the given months are listed, only those of the
        buckets opened."""
        schema, base = self.schemas[name], f"{self.root}/{name}"
        folders = self._folders(schema)
        read, hidden = [], []
        without = [without_run] if isinstance(without_run, str) else list(without_run or ())
        for part in version.parts(name):
            if part.run_id in without:
                continue
            path = f"{base}/part={part.name}"
            if MONTH in folders:
                wanted = part.months if months is None else [m for m in part.months if m in months]
                read += [f"{path}/{MONTH.name}={m}" for m in wanted]
            else:
                read.append(path)
            hidden += [(part.name, run) for run in part.without]
        if not read:
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])).option(
            "basePath", base).parquet(*read)
        if months is not None and MONTH in folders:
            dated = F.col(MONTH.name).isin(list(months))
            table = table.where(dated | F.col(MONTH.name).isNull() if NO_MONTH in months else dated)
        if buckets is not None and BUCKET in folders:
            table = table.where(F.col(BUCKET.name).isin(list(buckets)))
        if hidden:
            gone = self.spark.createDataFrame(hidden, "part string, run_id string")
            table = table.join(F.broadcast(gone), ["part", "run_id"], "left_anti").select(*table.columns)
        if without:
            table = table.where(~F.col("run_id").isin(without))
        table = table.drop("part")
        return table if scope is None else table.where(F.col("scope") == scope)

    def _read(self, name: str, without_run: str | Sequence[str] | None, scope: str | None, **cut) -> DataFrame:
        return self._rows(self.version or self.manifests.current(), name, without_run, scope, **cut)

    @staticmethod
    def _folders(schema: T.StructType) -> list[T.StructField]:
        return [f for f in (MONTH, BUCKET) if f in schema.fields]

    def run_log(self, without_run: str | Sequence[str] | None = None, scope: str | None = None) -> DataFrame:
        return self._read("run_log", without_run, scope)

    def reported(
        self, without_run: str | None = None, scope: str | None = None,
        months: Sequence[str] | None = None, buckets: Sequence[int] | None = None,
    ) -> DataFrame:
        """Items of committed runs; a repeated run passes its own id to leave itself out. Scopes
        share the tables and nothing else: without one, the items of all. With `months` (yyyy-MM) and
        `buckets`, the items of issues there; files of others are not opened."""
        return self._read("reported_items", without_run, scope, months=months, buckets=buckets)

    def processed(self, without_run: str | Sequence[str] | None = None, scope: str | None = None) -> DataFrame:
        """Scope and id of processed issues, repeats included: enough to leave them out."""
        return self._read("issue_progress", without_run, scope).select("scope", "issue_id")

    def progress(self, without_run: str | Sequence[str] | None = None, scope: str | None = None) -> DataFrame:
        """Latest progress row per scope and issue; of equal times that of the greater run id."""
        rows = self._read("issue_progress", without_run, scope)
        return merge.latest(rows, ["scope", "issue_id"], ["processed_at", "run_id"])

    def open_issues(
        self, scope: str | None = None, without_run: str | Sequence[str] | None = None, due: datetime | None = None,
    ) -> DataFrame:
        """Issues that a committed run left open and no later one processed, as they were last seen in
        their scope; with `due`, those whose next try is not after it."""
        rows, key = self._read("open_issues", without_run, scope), ["scope", "issue_id"]
        last = merge.latest(rows, key, ["seen_at", "run_id"])
        done = self.progress(without_run, scope).select(*key, F.struct("processed_at", "run_id").alias("_done"))
        still = last.join(done, key, "left").where(
            F.col("_done").isNull() | (F.struct("seen_at", "run_id") > F.col("_done"))).drop("_done")
        return still if due is None else still.where(F.col("next_try") <= F.lit(due))

    def open_bodies(self, scope: str, issues: DataFrame, without_run: str | None = None) -> DataFrame:
        """The last body kept of each of these issues (issue_id, html)."""
        rows = self._read("open_bodies", without_run, scope).join(issues.select("issue_id"), "issue_id", "left_semi")
        return merge.latest(rows, ["issue_id"], ["seen_at", "run_id"]).select("issue_id", "html")

    # -- one run ---------------------------------------------------------------

    def window(
        self, run_date: date, lookback_days: int, seed: bool = False, without_run: str | None = None,
        scope: str | None = None,
    ) -> tuple[date, date]:
        last_run = merge.last_run_date(self.run_log(without_run, scope)).first().last_run
        return merge.run_window(run_date, last_run, lookback_days, seed)

    def windows(
        self, run_date: date, lookback_days: int, seed: bool, without_run: Sequence[str], scopes: Sequence[str],
    ) -> dict[str, tuple[date, date]]:
        """`window` of every scope, from one read of the log: a date per scope is all that comes back."""
        log = self.run_log(without_run).where(F.col("scope").isin(list(scopes)))
        last = {r.scope: r.last_run for r in merge.last_run_date(log, "scope").collect()}
        return {s: merge.run_window(run_date, last.get(s), lookback_days, seed) for s in scopes}

    def _write(self, name: str, rows: DataFrame, run_id: str) -> Part:
        """A new part with the rows, which nobody sees yet."""
        schema = self.schemas[name]
        folders = [f.name for f in self._folders(schema)]
        if run_id:
            rows = rows.withColumn(RUN_ID.name, F.lit(run_id))
        if MONTH.name in folders:
            rows = rows.withColumn(MONTH.name, issue_month(F.col("issue_date")))
        if BUCKET.name in folders:
            rows = rows.withColumn(BUCKET.name, issue_bucket(F.col("issue_number")))
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        part = uuid.uuid4().hex
        path = f"{self.root}/{name}/part={part}"
        writer = out.repartition(*(folders or [RUN_ID.name])).write.partitionBy(*folders)
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return Part(part, run_id, self._months(path) if folders else ())

    def _months(self, path: str) -> tuple[str, ...]:
        folder = self.manifests._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in self.manifests.files(folder).listStatus(folder)]
        return tuple(sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{MONTH.name}=")))

    def _write_run(self, name: str, rows: DataFrame, run_id: str) -> DataFrame:
        part = self._write(name, rows, run_id)
        self._written.setdefault(run_id, {})[name] = part
        return self._rows(Version(0, {name: (part,)}), name)

    def mark_reported(
        self, items: DataFrame, run_id: str, run_ts: datetime,
        keys: tuple[str, ...] = ("issue_number", "anchor"), scope: str = "hr",
    ) -> int:
        """Append items whose key is not there; returns how many were inserted.

        Keys that hold the issue number are looked up in the months and buckets of the items alone: an
        issue number has one date. Other keys are looked up in the whole table.
        """
        cut = self.months_and_buckets(items) if "issue_number" in keys else {}
        new = merge.insert_if_absent(
            items, self.reported(run_id, scope, **cut), list(keys), ["issue_id", "pos"])
        new = new.withColumn("scope", F.lit(scope))
        stamped = new.withColumn("dedup_key", dedup_key(F.col("issue_number"), F.col("anchor")))
        stamped = stamped.withColumn("reported_at", F.lit(run_ts.replace(microsecond=0)))
        return self._write_run("reported_items", stamped, run_id).count()

    @staticmethod
    def months_and_buckets(issues: DataFrame) -> dict[str, list]:
        """Where the items of these issues (issue_number, issue_date) lie: months and buckets, few of both."""
        at = issues.agg(
            F.collect_set(F.coalesce(issue_month(F.col("issue_date")), F.lit(NO_MONTH))).alias("months"),
            F.collect_set(issue_bucket(F.col("issue_number"))).alias("buckets")).first()
        return {"months": sorted(at.months), "buckets": sorted(at.buckets)}

    def mark_processed(self, progress: DataFrame, run_id: str, scope: str = "hr") -> None:
        self._write_run("issue_progress", progress.withColumn("scope", F.lit(scope)), run_id)

    def mark_open(
        self, issues: DataFrame, run_id: str, run_ts: datetime, scope: str = "hr",
        retry_after: timedelta = timedelta(0),
    ) -> DataFrame:
        """Issues (with their `reason`) to try again: after `retry_after`, twice that, and so on up to a day."""
        now = F.lit(run_ts.replace(microsecond=0))
        before = self.open_issues(scope, run_id).select("issue_id", F.col("attempts").alias("_tried"))
        tried = issues.join(before, "issue_id", "left").withColumn("attempts", F.coalesce("_tried", F.lit(0)) + 1)
        wait = F.least(F.lit(retry_after.total_seconds()) * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(86400.0))
        return self._write_run("open_issues", tried.withColumns({
            "scope": F.lit(scope), "seen_at": now,
            "next_try": F.timestamp_seconds(F.unix_timestamp(now) + wait.cast("long"))}), run_id)

    def keep_bodies(self, bodies: DataFrame, run_id: str, run_ts: datetime, scope: str = "hr") -> None:
        """Bodies (issue_id, issue_date, html) of issues left open, to be read again when they are tried again."""
        self._write_run("open_bodies", bodies.withColumns({
            "scope": F.lit(scope), "seen_at": F.lit(run_ts.replace(microsecond=0))}), run_id)

    def log_row(self, **values) -> DataFrame:
        """A row of the run log; what is not given is NULL, lists are empty, the path too."""
        row = {"report_path": "", "warnings": [], "errors": [], **values}
        return self.spark.createDataFrame(
            [tuple(row.get(f.name) for f in schemas.RUN_LOG.fields)], schemas.RUN_LOG)

    def commit(self, run_row: DataFrame, run_id: str) -> None:
        """Make what the run wrote, and its log row, the state; what the id left before no longer counts."""
        self._write_run("run_log", run_row, run_id)
        written = self._written.pop(run_id)

        def change(tables):
            log = self._rows(Version(0, tables), "run_log")
            folded = any(not p.run_id for p in tables.get("run_log", ()))
            again = folded and not log.where(F.col("run_id") == run_id).isEmpty()
            out = {}
            for name in self.schemas:
                others = [p for p in tables.get(name, ()) if p.run_id != run_id]
                if again:
                    others = [p if p.run_id else replace(p, without=tuple({*p.without, run_id})) for p in others]
                out[name] = (*others, *[part for n, part in written.items() if n == name])
            return out
        self.manifests.switch(change)

    # -- views -----------------------------------------------------------------

    def total_reported(self) -> int:
        return merge.total_reported(self.run_log()).first().total_reported

    def state_view(self, limit: int = 50) -> DataFrame:
        """Newest reported items as shown to a person."""
        rows = merge.reported_in_window(self.reported(), *ANY_DATE).limit(limit)
        return state_rows(rows)


def issue_month(issue_date: Column) -> Column:
    return F.date_format(issue_date, "yyyy-MM")


def issue_bucket(issue_number: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(issue_number, F.lit(""))), F.lit(BUCKETS)).cast("int")


def state_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "issue_number", "anchor", "issue_date", score_text(F.col("score")).alias("score"),
        short_summary(F.col("one_line_summary")).alias("summary"))
