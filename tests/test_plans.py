"""What the plans must look like for large inputs."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lawtide.functions.binding import computed_once
from lawtide.functions.lexicon import HR_SCOPE
from lawtide.functions.text import content_hash
from lawtide.operators import counts, dedupe, paragraphs, prefilter, scoring
from lawtide.operators.ordered import first_per
from lawtide.plans.catalog import QUERIES
from lawtide.plans.derived import Tables
from lawtide.sources import listing

SF = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"k1_model_scores", "k2_repaired", "k3_errors", "k4_enriched"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.fixture
def big(spark, tmp_path):
    """Paragraphs of three issues; one issue and key hold most rows."""
    rows = spark.range(0, 60_000, numPartitions=8).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 2).cast("string")).alias("issue_id"),
        F.lit("n").alias("issue_number"), F.col("id").alias("pos"),
        F.when(F.col("id") % 10 < 8, F.lit("1. §")).otherwise(F.concat("id", F.lit(". §"))).alias("anchor"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


def test_only_model_queries_leave_the_jvm(spark):
    tables = Tables(spark, SF)
    # Those that write as they are built are looked at elsewhere.
    building = {"a6_report_files", "m1_arrivals", "m2_recent_stream", "m1_retries", "m2_expiring_keys"} | PYTHON_QUERIES
    for name, query in QUERIES.items():
        if name not in building:
            text = plan(query(tables))
            assert "InArrow" not in text and "InPandas" not in text and "Python" not in text, name
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_lexicon_filter_is_below_the_model_call(spark, big):
    hits = prefilter.keyword_filter(big, HR_SCOPE).withColumn("request", F.col("text")).withColumn("request_id", F.col("pos"))
    text = plan(scoring.call_model(hits, lambda: lambda x: x, 5))
    assert text.index("MapInArrow") < text.index("RLIKE")
    assert "REPARTITION_BY_NUM" in text
    assert "content_hash" not in text[: text.index("RLIKE")], "only ids and requests go to the model"


def test_window_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(QUERIES["d2_window"](Tables(spark, SF)))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text and "GreaterThanOrEqual(o_orderdate" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema.count(":") == 2 < len(orders.columns)


def test_cap_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["h2_cap"](Tables(spark, SF)))


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["c1_content_hash"](Tables(spark, SF)))
    assert re.search(r"ReadSchema: struct<([^>]*)>", text).group(1) == "doc_id:bigint,text:string"


def test_first_per_key_is_cut_before_the_shuffle(spark, big):
    text = plan(first_per(big, ["issue_number", "anchor"], ["issue_id", "pos"]))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)


def test_counts_are_combined_before_the_shuffle(spark, big):
    assert re.search(r"HashAggregate[\s\S]*Exchange[\s\S]*HashAggregate", plan(counts.per_issue(big, "n")))


def test_sections_and_chunks_do_not_shuffle(spark):
    tables = Tables(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumnRenamed("page_id", "issue_id")
    assert "Exchange" not in plan(paragraphs.html_paragraphs(pages))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("issue_id"), F.col("text").alias("page_text"))
    assert "Exchange" not in plan(paragraphs.text_chunks(texts))
    assert "Exchange" not in plan(prefilter.tag_topics(texts, text="page_text"))
    assert tables.folder == SF


def test_small_sides_are_broadcast_and_large_ones_are_not(spark, big):
    known = big.select("issue_number", "anchor").where("pos % 7 = 0").distinct()
    text = final_plan(dedupe.unreported(big, known.limit(10)))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1k")
    try:
        text = final_plan(dedupe.unreported(big, known))
        assert "SortMergeJoin" in text and "LeftAnti" in text and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hot_keys_are_split_in_joins(spark, big, tmp_path):
    """A key with most of the rows: the anti, left and semi joins split its partition."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # State is a table of unique keys, not an aggregate of this plan.
        big.where("pos % 10 = 9").select("issue_number", "anchor").distinct().write.parquet(str(tmp_path / "k"))
        known = spark.read.parquet(str(tmp_path / "k"))
        joined = dedupe.unreported(big, known)
        assert joined.count() == 54_000
        assert "skew=true" in final_plan(joined)
        issues = spark.createDataFrame([("hot", "n1", None), ("0", "n2", None)],
                                       "issue_id string, issue_number string, issue_date date")
        named = dedupe.with_issue(big.drop("issue_number"), issues)
        assert "skew=true" in final_plan(named)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_costly_columns_are_not_copied_into_filters(spark, big):
    plain = big.withColumn("h", content_hash(F.col("text"))).where("h <> ''")
    once = computed_once(big, h=content_hash(F.col("text"))).where("h <> ''")
    assert plan(plain).count("sha2(") > plan(once).count("sha2(") == 1


def test_report_order_is_a_range_sort(spark):
    from lawtide.plans import report
    lines = spark.range(10).select(
        F.lit("r").alias("run_id"), F.lit(1).alias("part"), F.current_date().alias("issue_date"),
        F.lit("n").alias("issue_number"), F.lit(1).alias("level"), F.lit("a").alias("anchor"),
        F.xxhash64("id").alias("pos"), F.lit(0).alias("line_no"), F.lit("x").alias("line"))
    assert "rangepartitioning" in plan(report.in_report_order(lines))


def test_newest_first_sort_is_global(spark):
    issues = spark.createDataFrame([("a", None)], "issue_id string, issue_date date")
    assert "rangepartitioning" in plan(listing.newest(issues.repartition(4)))


def test_archive_is_cut_to_the_issues_and_landings_are_one_each(spark):
    from lawtide.plans.run import Landed, of_issues
    table = spark.createDataFrame(
        [("2026/7", "<p>x</p>"), ("2026/7", "<p>y</p>"), ("2026/8", None), ("2026/9", "<p>z</p>")], "issue_id string, html string")
    issues = spark.createDataFrame([("2026/7",), ("2026/8",)], "issue_id string")
    cut = of_issues(Landed(table, table, table, table), issues)
    assert [tuple(r) for r in cut.bodies.collect()] == [tuple(r) for r in cut.justifications.collect()] == [("2026/7", "<p>y</p>")]
    assert cut.page_texts.count() == 3


def test_state_is_pruned_by_month_and_bucket(spark, tmp_path, monkeypatch):
    from lawtide.state import MonitorState, merge
    state = MonitorState(spark, str(tmp_path / "state")).create()
    items = Tables(spark, SF).v_items.withColumn("content_hash", F.lit("h"))
    state.mark_reported(items, "r1", datetime(2026, 7, 2))
    state.commit(state.log_row(run_id="r1", scope="hr"), "r1")
    march = state.reported(months=["2024-03"])
    assert march.count() and all("issue_month=2024-03" in f for f in march.inputFiles())
    assert state.reported(months=["2026-07"]).inputFiles() == []

    # The insert looks its keys up in the folders of the batch alone.
    few = items.where("doc_id = 14").limit(3)
    seen = []
    insert = merge.insert_if_absent
    monkeypatch.setattr(merge, "insert_if_absent", lambda new, table, *rest: (seen.append(table), insert(new, table, *rest))[1])
    assert state.mark_reported(few, "r2", datetime(2026, 7, 3)) == 0
    text = plan(seen[0])
    assert re.search(r"PartitionFilters: \[[^\]]*issue_month[^\]]*2024-03", text)
    assert re.search(r"PartitionFilters: \[[^\]]*key_bucket", text)
    assert all("issue_month=2024-03" in f for f in seen[0].inputFiles())
    (bucket,) = state.months_and_buckets(few)["buckets"]
    assert {r[0] for r in seen[0].select("key_bucket").distinct().collect()} == {bucket}


def test_empty_reports_read_the_items(spark):
    """A run of the log that an item belongs to has no empty report; all others have."""
    tables = Tables(spark, SF)
    told = {r[0] for r in QUERIES["l2_empty_reports"](tables).select("run_id").distinct().collect()}
    every = {r[0] for r in tables.v_runs.select("run_id").collect()}
    with_items = {f"r{r[0]:012d}" for r in tables.v_items.select("doc_id").distinct().collect()}
    assert every & with_items and told == every - with_items
    assert "LeftAnti" in plan(QUERIES["l2_empty_reports"](tables))
