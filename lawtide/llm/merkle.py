"""Merkle manifest of a dataset, with a proof for every row, by a butterfly exchange.

Rows are leaves; the leaves of a group, in order, are joined by runs of `fanout` up to the group's root,
and the groups' roots likewise up to the root of the dataset.

1. Leaves are sorted by range and numbered within their group from counts by range. Blocks of fanout ** depth
   leaves with aligned numbers make their own subtree, all blocks at once, each of bounded size.
2. The blocks of a group swap their roots round by round. In round r, a block meets the blocks whose number
   differs from its own in digit r alone (in base fanout): their nodes are the siblings of its own
   node, and all of them hash the same parent. So after the last round every block holds the root and
   the upper part of its rows' proofs; nothing is sent down the tree. Where the last blocks
   are too few to be partners of all, each of them serves several.
3. The roots of the groups go through the same steps as the leaves of one group.

Only hashes and row numbers travel: one row a block and round, and the leaves twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawtide.sources.workspace import Stage

#: A level of a proof: the siblings before and after the node, as hex digests.
PROOF = "array<struct<before:array<string>,after:array<string>>>"


def leaf(*columns: Column) -> Column:
    """Hex SHA-256 over all columns: `-` for null, else its length in UTF-8 bytes, `:` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined(nodes: Column) -> Column:
    """The parent of some nodes."""
    return F.sha2(F.array_join(nodes, ""), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda at, level: F.sha2(F.concat(
        F.array_join(level["before"], ""), at, F.array_join(level["after"], "")), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 over all siblings of a proof, from the leaf to the root, left to right."""
    return joined(F.flatten(F.transform(proof, lambda level: F.concat(level["before"], level["after"]))))


def _levels(leaves: Column, fanout: int, depth: int, alone: Column) -> Column:
    """The nodes of a block by level: `depth` levels above the leaves, fewer if it is alone in its group."""
    def above(nodes):
        runs = F.sequence(F.lit(1), F.size(nodes), F.lit(fanout))
        return F.transform(runs, lambda i: joined(F.slice(nodes, i, F.lit(fanout))))

    def step(levels, _):
        nodes = F.element_at(levels, -1)
        return F.when(alone & (F.size(nodes) == 1), levels).otherwise(F.concat(levels, F.array(above(nodes))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), step)


def _own_proof(levels: Column, place: Column, fanout: int) -> Column:
    """Siblings of the leaf at `place` (from 0) of a block, by level below the block's root."""
    def siblings(nodes, level):
        at = F.floor(place / F.pow(F.lit(float(fanout)), level)).cast("int")
        head = at - at % fanout
        return F.struct(
            F.slice(nodes, head + 1, at - head).alias("before"),
            F.slice(nodes, at + 2, F.lit(fanout - 1) - (at - head)).alias("after"))

    below = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(below, siblings)


def _numbered(rows: DataFrame, stage: Stage, order: Sequence[str], name: str) -> DataFrame:
    """Rows with `nth`, their number from 0 within their group, and `total`, the rows of the group."""
    dealt = stage(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("group", *order, "tie").withColumn("range", F.spark_partition_id()), f"{name}_dealt")
    of_group = Window.partitionBy("group")
    starts = stage(
        dealt.groupBy("group", "range").agg(F.count("*").alias("n")).select(
            "group", "range", F.sum("n").over(of_group).alias("total"),
            (F.sum("n").over(of_group.orderBy("range")) - F.col("n")).alias("start")), f"{name}_starts")
    within = F.row_number().over(Window.partitionBy("range", "group").orderBy(*order, "tie")) - 1
    return (
        dealt.withColumn("within", within).join(starts, ["range", "group"])
        .withColumn("nth", F.col("start") + F.col("within")))


def _exchanged(blocks: DataFrame, stage: Stage, fanout: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """blocks (group, block, blocks, node) after all rounds: (group, block, top), and for each round
    (group, block, round, before, after), the siblings that a block met."""
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    levels, width, state = [], 1, blocks
    while width < most:
        n, turn = F.col("blocks"), len(levels)
        # Blocks of one kind share all digits above this round's; `kind` is how many there are.
        block, digit = F.col("block"), F.floor(F.col("block") / width) % fanout
        family = block - block % (width * fanout)
        there = lambda d: F.least(F.lit(width).cast("long"), n - (F.col("family") + d * width))
        serves = F.when(F.col("digit") == F.col("to_digit"), F.array("place")).otherwise(
            F.sequence("place", F.col("room") - 1, "kind"))
        met = stage(
            state.where(n > width).withColumns({"digit": digit, "family": family, "place": block % width})
            .withColumn("kind", there(F.col("digit")))
            .withColumn("to_digit", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
            .withColumn("room", there(F.col("to_digit"))).where("place < room")
            .withColumn("to_place", F.explode(serves))
            .withColumn("to", F.col("family") + F.col("to_digit") * width + F.col("to_place"))
            .groupBy("group", F.col("to").alias("block"), "blocks").agg(
                F.array_sort(F.collect_list(F.struct("digit", "node"))).alias("nodes"),
                F.max(F.when(F.col("digit") == F.col("to_digit"), F.col("digit"))).alias("own")),
            f"{name}_round_{turn}")
        levels.append(met.select(
            "group", "block", F.lit(turn).alias("round"),
            F.expr("transform(filter(nodes, x -> x.digit < own), x -> x.node)").alias("before"),
            F.expr("transform(filter(nodes, x -> x.digit > own), x -> x.node)").alias("after")))
        state = state.where(n <= width).unionByName(
            met.select("group", "block", "blocks", joined(F.col("nodes.node")).alias("node")))
        width *= fanout
    return state.select("group", "block", F.col("node").alias("top")), levels


def _tree(
    rows: DataFrame, stage: Stage, order: Sequence[str], fanout: int, depth: int, name: str,
) -> tuple[DataFrame, DataFrame]:
    """Of rows (group, leaf, of, and the columns of `order`): the blocks (group, block, rows, levels), and what
    they know after the exchange (group, block, top: the group's root, upper: the proof from block to root)."""
    size = fanout ** depth
    blocks = stage(
        _numbered(rows, stage, order, name)
        .withColumns({
            "block": F.floor(F.col("nth") / size), "blocks": F.ceil(F.col("total") / size),
            "place": (F.col("nth") % size).cast("int")})
        .groupBy("group", "block", "blocks")
        .agg(F.array_sort(F.collect_list(F.struct("place", "leaf"))).alias("leaves"),
             F.collect_list(F.struct("place", "of")).alias("rows"))
        .withColumn("levels", _levels(F.col("leaves.leaf"), fanout, depth, F.col("blocks") == 1))
        .drop("leaves"), f"{name}_blocks", compression="zstd")
    tops, met = _exchanged(
        blocks.select("group", "block", "blocks", F.col("levels")[F.size("levels") - 1][0].alias("node")),
        stage, fanout, name)
    known = tops.withColumn("upper", F.array().cast(PROOF))
    if met:
        rounds = met[0]
        for other in met[1:]:
            rounds = rounds.unionByName(other)
        upper = rounds.groupBy("group", "block").agg(
            F.array_sort(F.collect_list(F.struct("round", "before", "after"))).alias("rounds"))
        known = tops.join(upper, ["group", "block"], "left").select("group", "block", "top", F.coalesce(
            F.expr("transform(rounds, x -> struct(x.before AS before, x.after AS after))").cast(PROOF),
            F.array().cast(PROOF)).alias("upper"))
    return blocks, stage(known, f"{name}_known")


def _proofs(blocks: DataFrame, known: DataFrame, fanout: int) -> DataFrame:
    """Every row of the blocks: of, leaf, top, proof and the other columns of known."""
    row = lambda at: F.struct(
        at["of"].alias("of"), F.col("levels")[0][at["place"]].alias("leaf"),
        F.concat(_own_proof(F.col("levels"), at["place"], fanout), F.col("upper")).alias("proof"))
    return (
        blocks.join(known, ["group", "block"])
        .withColumn("at", F.explode(F.transform("rows", row)))
        .select("at.*", *[c for c in known.columns if c not in ("block", "upper")]))


def manifest(
    rows: DataFrame, stage: Stage, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf", *,
    fanout: int = 3, depth: int = 5,
) -> DataFrame:
    """All rows and columns of rows as the column `row`, with leaf, subroot, root, proof.

    leaf_col holds the hash of a row (`leaf` makes one). Leaves of a group ascend by id; while there are
    several nodes, every `fanout` consecutive ones, the last of them fewer, become the hash of
    their hex digests. What remains is the subroot; subroots in the order of their groups, null
    first, give the root likewise. proof: the siblings of each level up to the root (`PROOF`), from
    which `folded` computes the root. Blocks hold fanout ** depth leaves.

    A null group is a group, null ids come first in it; rows of one id are ordered by their leaf, and
    equal ones are interchangeable. Empty rows give an empty result. Other columns travel along
    three times: select the narrow ones. The text a leaf was made of need not be among them.
    """
    group = F.col(group_col).cast("string")
    # Written before it is sorted: the range bounds are sampled from the rows, and texts are hashed once.
    keyed = stage(rows.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("group"),
        F.col(id_col).alias("id"), F.col(leaf_col).alias("leaf"), F.struct("*").alias("of")), "leaves")
    blocks, known = _tree(keyed, stage, ["id", "leaf"], fanout, depth, "rows")
    groups = known.where("block = 0").select(
        F.lit("").alias("group"), F.col("top").alias("leaf"), F.struct("group", "top").alias("of"), F.col("group").alias("name"))
    upper = _proofs(*_tree(groups, stage, ["name"], fanout, depth, "groups"), fanout)
    upper = stage(upper.select(
        F.col("of.group").alias("group"), F.col("top").alias("root"), F.col("proof").alias("of_group")), "upper")
    known = stage(
        known.join(upper, "group").withColumn("upper", F.concat("upper", "of_group")).drop("of_group"), "known")
    return _proofs(blocks, known, fanout).select(
        F.col("of").alias("row"), "leaf", F.col("top").alias("subroot"), "root", "proof")
