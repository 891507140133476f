"""URL filters: prefix rules on hosts and paths by a sort-merge range join, on DataFrame functions alone.

A rule covers its host with all subdomains, and all paths that start with its own. Both are prefixes: of the
labels of the host in reverse, `org.example.`, and of the path. A prefix is an interval of sorted keys.

1. Keys of URLs and starts of intervals are sorted together by range into buckets; keys that repeat are
   parted by a number of the row, so one URL or host may fill many buckets. A bucket is opened with the
   intervals that reach into it from before: those whose start is a prefix of its first key, by an equi-join.
2. Within a bucket the sorted keys are swept. A start pushes a rule on the stack and an end pops it: the
   running sum of both is the height of the stack, and what lies at a level is what was pushed there last.
3. A first sweep over the hosts gives each URL all hosts with rules on its stack, a second one over
   (rule host, path) the topmost path rule under each of these. The longest rule of a URL wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawtide.sources.workspace import Stage

_START, _KEY, _END = 0, 1, 2


def host_of(url: Column) -> Column:
    """What lies between the first `://` and the next `/`, `?`, `#`, A-Z in lower case; empty for others."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty for a URL without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, a point after each, so that a domain is a prefix of its subdomains."""
    return F.when(host == "", "").otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


def stacked(keys: DataFrame, rules: DataFrame, stage: Stage, name: str, *, topmost: bool) -> DataFrame:
    """Rows of keys (key string, row long, ...) with the rules (prefix string, distinct, and rule) on the
    stack at their key, as the column `rule`: the topmost one or all, a row each. With nothing on the
    stack, rule is null. `row` parts rows of the same key."""
    rules = rules.select(F.col("prefix").cast("binary").alias("sort"), "rule")
    events = (
        keys.select(F.col("key").cast("binary").alias("sort"), F.lit(_KEY).alias("kind"),
                    F.struct(*keys.drop("key").columns).alias("of"), F.col("row").alias("part"))
        .unionByName(rules.withColumns({"kind": F.lit(_START), "part": F.lit(-1).cast("long")}),
                     allowMissingColumns=True))
    dealt = stage(
        events.repartitionByRange("sort", "part").withColumn("bucket", F.spark_partition_id()), f"{name}_dealt")

    longest = rules.agg(F.max(F.octet_length("sort"))).first()[0] or 0
    reaching = (
        dealt.groupBy("bucket").agg(F.min("sort").alias("first"))
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.octet_length("first"), F.lit(longest)))))
        .select("bucket", F.expr("substring(first, 1, n)").alias("sort")).join(rules, "sort"))
    begun = dealt.where(F.col("kind") == _START)
    starts = stage(
        begun.select("bucket", "sort", "rule")
        .union(reaching.select("bucket", "sort", "rule")).dropDuplicates(["bucket", "sort"]), f"{name}_starts")
    # No byte of UTF-8 is FF: it closes an interval behind all keys with its prefix.
    ends = starts.select("bucket", F.concat("sort", F.lit(b"\xff")).alias("sort"), F.lit(_END).alias("kind"))

    swept = Window.partitionBy("bucket").orderBy("sort", "kind").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == _START, 1).when(F.col("kind") == _END, -1).otherwise(0)
    at = (
        dealt.where(F.col("kind") == _KEY).select("bucket", "sort", "kind", "of")
        .unionByName(starts.withColumn("kind", F.lit(_START)), allowMissingColumns=True)
        .unionByName(ends, allowMissingColumns=True)
        .withColumn("height", F.sum(step).over(swept).cast("int")).where(F.col("kind") != _END))
    if topmost:
        at = at.withColumn("level", F.col("height"))
    else:
        lowest = F.when((F.col("kind") == _KEY) & (F.col("height") > 0), 1).otherwise(F.col("height"))
        at = at.withColumn("level", F.explode(F.sequence(lowest, "height")))
    pushed = Window.partitionBy("bucket", "level").orderBy("sort", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        at.withColumn("rule", F.last("rule", ignorenulls=True).over(pushed))
        .where(F.col("kind") == _KEY).select("of.*", "rule"))


def url_verdicts(
    pages: DataFrame, rules: DataFrame, stage: Stage, url_col: str = "url", *, default: str = "allow",
) -> DataFrame:
    """All rows and columns of pages as the column `row`, with host, path, rule, verdict.

    rules: (host, path, verdict). A rule covers a URL whose host is the rule's or a subdomain of it and
    whose path starts with the rule's; an empty host covers all. Of several rules the one with the most
    characters of host and path counts, then the one with the longer host; of rules with one host and
    path the greatest verdict ("block" after "allow"). `rule` is host and path of the rule, null
    where none covers the URL: verdict is then `default`.

    null URLs and URLs without `://` have an empty host and path. Hosts are compared as they stand,
    with port and user if given. Null hosts and paths of rules count as empty, A-Z in hosts as a-z.
    Repeated rows are judged each; rows of pages may carry any other columns.
    """
    url = F.col(url_col).cast("string")
    told = stage(
        pages.select(F.struct("*").alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("nth", F.monotonically_increasing_id()), "told")
    small = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ruled = stage(
        rules.select(small.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("under", host_key(F.col("host"))), "ruled")
    full = F.concat("host", "path")
    by_host = ruled.select("under").distinct().select(
        F.col("under").alias("prefix"), F.struct("under").alias("rule"))
    # No host holds a "/": the first one ends the host in a key.
    by_path = ruled.select(
        F.concat("under", F.lit("/"), "path").alias("prefix"),
        F.struct(F.length(full).alias("size"), F.length("host").alias("of_host"), full.alias("rule"), "verdict").alias("rule"))

    hosts = stacked(
        told.select(host_key(F.col("host")).alias("key"), F.col("nth").alias("row"), "path"),
        by_host, stage, "hosts", topmost=False).where("rule IS NOT NULL")
    paths = stacked(
        hosts.select(F.concat("rule.under", F.lit("/"), "path").alias("key"), "row"),
        by_path, stage, "paths", topmost=True).where("rule IS NOT NULL")
    best = stage(paths.groupBy(F.col("row").alias("nth")).agg(F.max("rule").alias("best")), "best")
    return told.join(best, "nth", "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
