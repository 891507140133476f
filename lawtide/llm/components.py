"""Connected components of a graph given by its links, on Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawtide.sources.workspace import Stage


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    links: (a long, b long), in either direction, repeats allowed. Every round, each node points to
    the smallest of itself and its neighbours and follows these pointers to their end, by doubling.
    Then links are drawn between the ends alone, once each, so the next round reads what is not
    connected yet, not all links again. Two rounds halve the nodes that still have links, at least.
    Nothing is gathered by node, so a node may have any number of links.
    """
    left = stage(_once(links, "a", "b"), f"{name}_links_0")
    turns: list[DataFrame] = []
    while True:
        turn = len(turns)
        either = left.union(left.select(F.col("b"), F.col("a")))
        least = either.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
        to, jumps = stage(_followed(least), f"{name}_{turn}_0"), 0
        while not to.where("component != was").isEmpty():
            jumps += 1
            to = stage(_followed(to.select("node", "component")), f"{name}_{turn}_{jumps}")
            stage.drop(f"{name}_{turn}_{jumps - 1}")
        turns.append(to.select("node", "component"))
        at_a = to.select(F.col("node").alias("a"), F.col("component").alias("end_a"))
        at_b = to.select(F.col("node").alias("b"), F.col("component").alias("end_b"))
        ends = left.join(at_a, "a").join(at_b, "b").where("end_a != end_b")
        left = stage(_once(ends, "end_a", "end_b"), f"{name}_links_{turn + 1}")
        stage.drop(f"{name}_links_{turn}")
        if left.isEmpty():
            break
    labels = turns[0]
    for to in turns[1:]:
        end = to.select(F.col("node").alias("component"), F.col("component").alias("end"))
        labels = labels.join(end, "component", "left").select(
            "node", F.coalesce("end", "component").alias("component"))
    return labels


def _once(links: DataFrame, one: str, two: str) -> DataFrame:
    return links.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _followed(to: DataFrame) -> DataFrame:
    """(node, component) with the component's own for it, and what it was."""
    step = to.select(F.col("node").alias("was"), F.col("component").alias("next"))
    return to.withColumnRenamed("component", "was").join(step, "was").select(
        "node", F.col("next").alias("component"), "was")
