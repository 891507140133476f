"""Near-duplicate documents: min-max hashing, banding, links confirmed on full shingle sets.

Each permutation of the shingles gives two signature values, its smallest and its largest image,
so a signature of 2k values costs k hash evaluations per shingle. Both agree between two sets with
a probability equal to their Jaccard similarity, so bands of either kind are unbiased.

1. One pass over the texts makes a row per document: set size, 128-bit digest of the set, band keys.
2. Documents with equal sets become one node; hot groups of copies end there.
3. Nodes that share a bucket of any band belong to one family: every node points to its bucket's
   smallest node, and a family is what these pointers connect. The node that shares buckets with the most
   others is the family's centre.
4. Sets are replaced by their differences D from the set of a centre, the frame, as the symmetric
   difference of two sets equals that of their D. With sizes known, w = (100 + p) |D| - (100 - p) |set|
   says how far a set is from the centre, and x and y are linked exactly if
   w_x + w_y <= 2 (100 + p) |D_x & D_y|. All pairs with w_x + w_y <= 0 are linked, and so is either of them
   with the node of the smallest w: one star per frame stands for all of these links.
5. Nodes beyond the star look for a nearer centre: of the node pointers they share with the most others
   beyond it, the most central one. Rounds go on while they move enough nodes, so a second cluster of near
   copies in a family gets a frame and a star of its own.
6. Every other link needs a common element of both D, and a common one among the rarest (prefix
   filter): of the elements of D, rarest within the frame first, the first |D| - o + 1 of both share one
   if the overlap is o or more. So nodes meet by an equi-join on (frame, rare element), where what a
   cluster has in common is in no D; nodes of two frames of a family meet by differences from the
   family's centre. Where nodes share a rare element, each is compared with the nearest of them first; all
   other pairs are compared only between parts that are not connected then. All links are confirmed on D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawtide.llm.components import components
from lawtide.llm.words import SPACED, U, Words, mixed, places, slices, spans, words_of
from lawtide.sources.workspace import Stage


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one after the other, and where each text's begin.

    A text of fewer than n words has one shingle, the whole of it; one without words has none.
    """
    hashes, counts = words.hashes(), words.counts
    at = places(words.first, n)
    keys = [spans(hashes, at, n)]
    text = [np.searchsorted(words.first, at, "right") - 1]
    for few in range(1, n):
        short = np.flatnonzero(counts == few)
        if len(short):
            keys.append(spans(hashes, words.first[short], few))
            text.append(short)
    keys, text = np.concatenate(keys), np.concatenate(text)
    order = np.argsort(text, kind="stable")
    keys, first = keys[order], np.searchsorted(text[order], np.arange(len(counts) + 1))
    sets = [np.unique(keys[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return (np.concatenate(sets) if sets else keys), np.cumsum([0, *map(len, sets)])


def digests(keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 bits for each set, from sums over its members; begin: where the sets begin."""
    parts = [np.add.reduceat(mixed(keys ^ U(c)), begin) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.stack(parts, axis=1)


def band_keys(keys: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of all bands for each set. A band holds `rows` signature values: the smallest images under
    rows / 2 permutations (multiplication by an odd number), and the largest under those of the next
    band, as the two ends of one permutation are not independent in small sets."""
    half = rows // 2
    factors = mixed(np.arange(1, bands * half + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    low, high = np.empty((2, len(factors), len(begin)), U)
    for i, factor in enumerate(factors):
        image = keys * factor
        np.minimum.reduceat(image, begin, out=low[i])
        np.maximum.reduceat(image, begin, out=high[i])
    high = np.roll(high, -half, axis=0)
    out = np.empty((len(begin), bands), U)
    for band in range(bands):
        key = np.full(len(begin), band + 1, U)
        for i in range(band * half, (band + 1) * half):
            key = mixed(mixed(key ^ low[i]) ^ high[i])
        out[:, band] = key
    return out


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of an integer matrix as binary cells."""
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _signed(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                words = words_of(batch["text"].slice(a, b - a), SPACED, lower=True)
                keys, first = shingle_sets(words, n)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                digest, lists = pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.list_(pa.int64()))
                if len(some):
                    begin = first[:-1][some]
                    pick = np.full(b - a, -1)
                    pick[some] = np.arange(len(some))
                    pick = pa.array(pick, mask=pick < 0)
                    digest = _fixed(digests(keys, begin)).take(pick)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, (len(some) + 1) * bands, bands), pa.int32()),
                        pa.array(band_keys(keys, begin, bands, rows).view(np.int64).ravel())).take(pick)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(sizes, pa.int64()), digest, lists],
                    ["id", "key", "n_shingles", "digest", "bands"])
    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                keys, first = shingle_sets(words_of(batch["text"].slice(a, b - a), SPACED, lower=True), n)
                edges = first.tolist()
                sets = [keys[x:y] for x, y in zip(edges, edges[1:])]
                found = [digests(x, np.zeros(1, np.int64)).tobytes() if len(x) else None for x in sets]
                same = [x == y.as_py() for x, y in zip(found, batch["digest"].slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [batch["family"].slice(a, b - a), batch["node"].slice(a, b - a),
                     pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["family", "node", "members"]).filter(pa.array(same, pa.bool_()))
    return run


def _differences(percent: int):
    """Sets as differences from that of their frame, where that is nearer than `was`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists = [], []
            for own, centre in zip(batch["members"], batch["of_centre"]):
                own, centre = (np.frombuffer(v.as_buffer(), U) for v in (own, centre))
                sizes.append(len(own))
                lists.append(np.setxor1d(own, centre, assume_unique=True).view(np.int64))
            apart = np.array([len(x) for x in lists], np.int64)
            w = (100 + percent) * apart - (100 - percent) * np.array(sizes, np.int64)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            nearer = w < batch["was"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch["family"], batch["frame"], batch["node"], pa.array(w), pa.array(apart), pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *apart]), pa.int32()), pa.array(values))],
                ["family", "frame", "node", "w", "apart", "diff"]).filter(pa.array(nearer))
    return run


def near_duplicates(
    docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", *,
    shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6,
) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z in lower case; a document's set are its distinct
    shingles of `shingle` words, or the whole sequence if it has fewer. Two documents are linked
    where 100 * |intersection| >= percent * |union|; a component is what links reach, named by
    its smallest id. kept: the id is the component's.

    A pair at similarity s shares no bucket with a probability of (1 - s^rows)^bands: 5e-7 at 0.8
    and less above, with the defaults. Every other step is exact.

    null or empty text, or one without words: no shingles, linked with nothing, a component of its
    own. Rows of one id and one set are one node; rows of one id and different sets are
    different nodes whose components may have the same name. A null id is never a component's
    name unless all ids in it are null. Columns beyond the two named are not read.
    """
    before = set(stage.written)
    id_type = docs.schema[id_col].dataType
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = id_type.simpleString()
    signed = stage(source.mapInArrow(
        _signed(shingle, bands, rows),
        f"id {kind}, key long, n_shingles long, digest binary, bands array<long>"), "signed")
    # The row that a node's text is read from is named by id and text, as ids may be null or repeat.
    nodes = stage(
        signed.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("bands").alias("bands"),
             F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("of"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")

    in_band = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = stage(
        in_band.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("members"))
        .where("members > 1"), "hubs")
    met = stage(in_band.join(hubs, "bucket").select("node", "hub", "members"), "met")
    families = components(
        met.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(),
        stage, "families").withColumnRenamed("component", "family")
    crowds = met.groupBy("node").agg(F.sum("members").alias("crowd"))
    families = stage(
        families.join(crowds, "node").join(nodes.select("node", "digest", "of.id", "of.key"), "node"),
        "families")
    centres = stage(
        families.groupBy("family")
        .agg(F.max(F.struct("crowd", (-F.col("node")).alias("minus")))["minus"].alias("minus"))
        .select("family", (-F.col("minus")).alias("centre")), "centres")

    # Merged at any size: a plan that broadcasts small sides grows faster than its input.
    wanted = families.select("family", "node", "digest", F.col("id").alias("of_id"), F.col("key").alias("of_key"))
    sets = stage(
        source.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
        .select("family", "node", "digest", "text")
        .mapInArrow(_sets(shingle), "family long, node long, members binary")
        .dropDuplicates(["node"]), "sets")
    reached = components(_links(sets, centres, families, met, stage, percent), stage, "reached")

    placed = nodes.select("node", "digest", "id").join(reached, "node", "left")
    placed = stage(placed.select(
        "digest", "id", F.coalesce("component", "node").alias("component")), "placed")
    names = stage(placed.groupBy("component").agg(F.min("id").alias("component_id")), "names")
    named = stage(placed.join(names, "component").select("digest", "component_id"), "named")
    stage.drop(*(stage.written - before - {"signed", "named"}))
    return (
        signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .select(
            F.col("id").alias(id_col), "n_shingles", "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


#: As many nodes beyond stars that share a bucket are worth a centre; a round that moves less than this
#: share of those that look for one is the last. Both decide on the work only, not on the links.
_CROWD, _SHARE = 16, 1 / 8


def _links(
    sets: DataFrame, centres: DataFrame, families: DataFrame, met: DataFrame, stage: Stage, percent: int,
) -> DataFrame:
    """Links (a, b) that connect what all links connect."""
    unit = 2 * (100 + percent)

    def differences(asked: DataFrame, frames: DataFrame, on: str, name: str) -> DataFrame:
        """Differences of sets (family, node, members, was) from the set of their frame (frame, and `on`)."""
        centred = stage(
            frames.join(sets.select(F.col("node").alias("frame"), F.col("members").alias("of_centre")), "frame"),
            f"{name}_centres")
        return stage(
            asked.join(centred, on).select("family", "frame", "node", "was", "members", "of_centre")
            .mapInArrow(_differences(percent), "family long, frame long, node long, w long, apart long, diff array<long>"),
            f"{name}_diffs")

    first = framed = differences(
        sets.withColumn("was", F.lit(2**62)), centres.withColumnRenamed("centre", "frame"), "family", "round_0")
    turn = 0
    while True:
        weighed = stage(_weighed(framed), f"weighed_{turn}")
        far = weighed.where("out").select("family", "node", F.col("w").alias("was"))
        at_hub = stage(
            met.join(far, "node").select("family", "node", "was", "hub").distinct()
            .join(families.select("node", "crowd"), "node"), f"at_hub_{turn}")
        hubs = stage(
            at_hub.groupBy("hub").agg(
                F.count("*").alias("n"), F.max(F.struct("crowd", (-F.col("node")).alias("minus"))).alias("centre"))
            .where(F.col("n") >= _CROWD), f"crowds_{turn}")
        if hubs.isEmpty():
            break
        turn += 1
        chosen = stage(
            at_hub.join(hubs, "hub").groupBy("family", "node", "was")
            .agg(F.max(F.struct("n", "hub", (-F.col("centre.minus")).alias("frame"))).alias("best"))
            .select("family", "node", "was", F.col("best.frame").alias("frame")), f"chosen_{turn}")
        own = chosen.select(F.col("frame").alias("own")).distinct()
        asked = stage(
            chosen.join(own, F.col("node") == F.col("own"), "left")
            .select("family", "node", "was", F.coalesce("own", "frame").alias("frame")), f"asked_{turn}")
        moved = differences(
            sets.join(asked.drop("family"), "node"), asked.select("frame").distinct(), "frame", f"round_{turn}")
        framed = stage(
            framed.join(moved.select("node"), "node", "left_anti").unionByName(moved), f"framed_{turn}")
        if moved.count() < _SHARE * asked.count():
            weighed = stage(_weighed(framed), f"weighed_{turn}")
            break

    star = weighed.where("NOT out AND node != nearest").select(
        F.col("nearest").alias("a"), F.col("node").alias("b"))
    links = star.unionByName(_within_frames(weighed, framed, stage, unit))
    if turn:
        links = stage(links, "links_of_frames")
        links = links.unionByName(_between_frames(weighed, first, links, stage, unit))
    return stage(links, "links")


def _needed(one, two, unit: int):
    """The least overlap of two differences that makes a link."""
    return F.ceil((one + two) / F.lit(unit))


def _weighed(framed: DataFrame) -> DataFrame:
    nearest = framed.groupBy("frame").agg(F.min(F.struct("w", "node")).alias("least"))
    return (
        framed.drop("diff").join(nearest, "frame")
        .select("family", "frame", "node", "w", "apart", F.col("least.w").alias("w_least"),
                F.col("least.node").alias("nearest"))
        .withColumn("out", (F.col("w") + F.col("w_least") > 0) & (F.col("node") != F.col("nearest"))))


def _ranked(rows: DataFrame, diffs: DataFrame, key: str, stage: Stage, name: str) -> DataFrame:
    """An element of D a row, with its place in D when ordered by how many nodes of the key have it;
    elements of one node alone come first and are left out."""
    elements = rows.join(diffs.select("node", "diff"), "node").withColumn("element", F.explode("diff")).drop("diff")
    common = stage(
        elements.groupBy(key, "element").agg(F.count("*").alias("n")).where("n > 1"), f"{name}_common")
    own = Window.partitionBy(key, "node")
    place = (
        F.col("apart") - F.count("*").over(own)
        + F.row_number().over(own.orderBy("n", "element")))
    return elements.join(common, [key, "element"]).withColumn("place", place)


def _within_frames(weighed: DataFrame, diffs: DataFrame, stage: Stage, unit: int) -> DataFrame:
    """Links between nodes of one frame, one of them at least beyond the star."""
    open_frames = stage(
        weighed.groupBy("frame")
        .agg(F.min(F.when(F.col("out"), F.col("w"))).alias("w_out")).where("w_out IS NOT NULL"), "open_frames")
    rows = weighed.join(open_frames, "frame").select(
        "frame", "node", "w", "apart", "out", "w_least", "w_out",
        F.when(F.col("out"), F.col("node")).otherwise(F.col("nearest")).alias("part"))
    as_any = F.col("apart") - _needed(F.col("w"), F.col("w_out"), unit) + 1
    as_out = F.col("apart") - _needed(F.col("w"), F.col("w_least"), unit) + 1
    ranked = stage(
        _ranked(rows, diffs, "frame", stage, "within")
        .where((F.col("place") <= as_any) | (F.col("out") & (F.col("place") <= as_out)))
        .select("frame", "element", "node", "w", "apart", "place", "part"), "within_ranked")
    return _connecting(ranked, diffs, "frame", stage, unit, "within")


def _between_frames(weighed: DataFrame, first: DataFrame, links: DataFrame, stage: Stage, unit: int) -> DataFrame:
    """Links between nodes of two frames of one family, by differences from the family's centre."""
    several = stage(
        weighed.groupBy("family").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).where("lo < hi"), "several")
    rows = (
        weighed.join(several.select("family"), "family")
        .select("node", "frame", (F.lit(unit) * F.col("apart") - F.col("w")).alias("spread"))
        .join(first.select("family", "node", "w", "apart"), "node"))
    # The least w of any other frame: that of the family, or for its own frame the next.
    of_frame = stage(rows.groupBy("family", "frame").agg(F.min("w").alias("w_min")), "of_frame")
    lowest = of_frame.groupBy("family").agg(F.min(F.struct("w_min", "frame")).alias("lowest"))
    beside = of_frame.join(lowest, "family")
    is_lowest = F.col("frame") == F.col("lowest.frame")
    next_ = beside.groupBy("family").agg(F.min(F.when(~is_lowest, F.col("w_min"))).alias("w_next"))
    other = beside.join(next_, "family").select(
        "frame", F.when(is_lowest, F.col("w_next")).otherwise(F.col("lowest.w_min")).alias("w_other"))
    known = components(
        links.join(rows.select(F.col("node").alias("a")), "a", "left_semi"), stage, "known")
    ranked = stage(
        _ranked(rows.join(other, "frame"), first, "family", stage, "between")
        .where(F.col("place") <= F.col("apart") - F.greatest(_needed(F.col("w"), F.col("w_other"), unit), F.lit(1)) + 1)
        .join(known, "node", "left")
        .select("family", "element", "node", "w", "apart", "place", "spread",
                F.coalesce("component", "node").alias("part"), F.col("frame").alias("side")), "between_ranked")

    # Symmetric differences are a metric: two nodes differ by what their frames' centres differ at least, less
    # what each differs from its centre. `bound` is that of the centres; a link needs bound <= both spreads.
    sides = ranked.select("family", "element", "side").distinct()
    meet = (
        sides.join(sides.select("family", "element", F.col("side").alias("other_side")), ["family", "element"])
        .where("side < other_side").select("side", "other_side").distinct())
    diff = lambda node, name: first.select(F.col("node").alias(node), F.col("diff").alias(name))
    distance = (
        F.size("of_side") + F.size("of_other") - 2 * F.size(F.array_intersect("of_side", "of_other"))).cast("long")
    widest = ranked.groupBy("side").agg(F.max("spread").alias("widest"))
    near = stage(
        meet.join(diff("side", "of_side"), "side").join(diff("other_side", "of_other"), "other_side")
        .select("side", "other_side", (distance * (unit // 2)).alias("bound"))
        .join(widest, "side").join(widest.select(F.col("side").alias("other_side"), F.col("widest").alias("as_wide")), "other_side")
        .where("bound <= widest + as_wide").select("side", "other_side", "bound"), "near_frames")
    near = near.union(near.select("other_side", "side", "bound"))
    return _connecting(ranked, first, "family", stage, unit, "between", near)


def _connecting(
    ranked: DataFrame, diffs: DataFrame, key: str, stage: Stage, unit: int, name: str, near: DataFrame | None = None,
) -> DataFrame:
    """Links (a, b) that connect what all links between nodes of ranked connect; with `near`, those
    between nodes of two sides (side, other_side, bound) it lists whose spreads reach the bound.

    ranked: the places of a node's rare elements; part: what it is connected with already. First all
    nodes with an element are compared with the nearest one that has it. Most are connected
    then, and every other pair is compared only where the parts still differ.
    """
    sharing, sides = [key, "element"], [] if near is None else ["side"]
    spread = [] if near is None else ["spread"]
    hubs = (
        ranked.groupBy(*sharing).agg(
            F.min(F.struct("w", "node", "part", *sides, *spread)).alias("hub"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        .where("lo < hi"))
    beside = ranked.join(hubs, sharing).where("part != hub.part")
    if near is not None:
        beside = (
            beside.withColumn("other_side", F.col("hub.side")).join(near, ["side", "other_side"])
            .where("bound <= spread + hub.spread"))
    at_hub = stage(
        beside.select(
            F.col("hub.node").alias("a"), F.col("node").alias("b"),
            F.greatest(_needed(F.col("w"), F.col("hub.w"), unit), F.lit(0)).alias("least"),
            F.col("hub.part").alias("part_a"), F.col("part").alias("part_b")).distinct(), f"{name}_hub_pairs")
    by_hub = _confirmed(at_hub, diffs, stage, f"{name}_hub")
    joined = components(
        by_hub.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), stage, f"{name}_joined")
    placed = stage(
        ranked.join(joined.withColumnRenamed("node", "part"), "part", "left")
        .withColumn("part", F.coalesce("component", "part")).drop("component"), f"{name}_placed")

    # The places of both allow a pair of x and y if w_y <= reach_x and w_x <= reach_y; so for parts.
    reach = F.lit(unit) * (F.col("apart") - F.col("place") + 1) - F.col("w")
    apart = placed.groupBy(*sharing).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    parts = stage(
        placed.groupBy(*sharing, "part", *sides).agg(F.max(reach).alias("reach"), F.min("w").alias("least_w"))
        .join(apart.select(*sharing), sharing), f"{name}_parts")
    told = ["part", *sides, "reach", "least_w"]
    others = parts.select(*sharing, *[F.col(c).alias(f"other_{c}") for c in told])
    meet = (
        parts.join(others, sharing)
        .where("part < other_part AND least_w <= other_reach AND other_least_w <= reach")
        .drop("reach", "least_w", "other_reach", "other_least_w"))
    meet = stage(meet if near is None else meet.join(near, ["side", "other_side"]), f"{name}_meet")
    one = placed.join(meet, [*sharing, "part", *sides]).alias("one")
    two = placed.alias("two")
    same = F.lit(True)
    for c, other in [(c, c) for c in sharing] + [(c, f"other_{c}") for c in ("part", *sides)]:
        same = same & (F.col(f"one.{other}") == F.col(f"two.{c}"))
    least = F.greatest(_needed(F.col("one.w"), F.col("two.w"), unit), F.lit(0))
    crossing = stage(
        one.join(two, same & (F.col("one.place") <= F.col("one.apart") - least + 1)
                 & (F.col("two.place") <= F.col("two.apart") - least + 1)
                 & (F.lit(True) if near is None else F.col("one.bound") <= F.col("one.spread") + F.col("two.spread")))
        .select(F.col("one.node").alias("a"), F.col("two.node").alias("b"), least.alias("least")).distinct(),
        f"{name}_pairs")
    return by_hub.select("a", "b").unionByName(_confirmed(crossing, diffs, stage, name).select("a", "b"))


def _confirmed(pairs: DataFrame, diffs: DataFrame, stage: Stage, name: str) -> DataFrame:
    """The pairs (a, b, least, ...) whose differences overlap in `least` elements."""
    return stage(
        pairs.join(diffs.select(F.col("node").alias("a"), F.col("diff").alias("of_a")), "a")
        .join(diffs.select(F.col("node").alias("b"), F.col("diff").alias("of_b")), "b")
        .where(F.size(F.array_intersect("of_a", "of_b")) >= F.col("least")).drop("of_a", "of_b"), f"{name}_confirmed")
