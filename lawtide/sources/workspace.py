"""Where intermediate tables live, so that a lost executor costs one stage at most."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where none is named, a local master gets a folder of its own (tests, trials). On a
    cluster that would be another folder on every machine, so there it raises.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lawtide-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run within drop their shuffle files when they end, not when the driver happens to
    collect its garbage. Only for queries whose result is written, as nothing reads them again."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Queries run within hand rows to Python as soon as they fill so many bytes, or at each row larger
    than that, where else some 64 MB are held at a time by a task and by its worker."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


class Stage:
    """Writes a DataFrame to a named table and returns the table.

    Needed where a result is used twice and must be computed once. `drop` removes tables that
    nothing will read again; without names, all of them. `written` names those that are there.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/lawtide-{uuid.uuid4().hex}"
        self.written: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def __call__(
        self, df: DataFrame, name: str, partition_by: str | None = None, **options: str
    ) -> DataFrame:
        writer = df.write.mode("overwrite").options(**options)
        with freed_shuffles(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        self.written.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def counted(
        self, df: DataFrame, name: str, partition_by: str | None = None, **figures: Column
    ) -> tuple[DataFrame, dict[str, int]]:
        """The table, and figures of its rows besides: `rows`, their number, and any aggregates. The job
        that writes the rows tells them, each task once, so they cost no job of their own."""
        told = Observation()
        seen = df.observe(told, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()])
        return self(seen, name, partition_by), told.get

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [self.path(name) for name in names] or [self.root]:
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)
        self.written -= set(names) or self.written
