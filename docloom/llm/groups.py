"""Components of alike sets that lie in common groups (nodes of a tree, buckets of a band), found without emitting pairs.

Input are members (path, node): classes of equal sets by name, in groups by name. A group may hold any share of the corpus.

1. Every class is compared with one pivot: of the smallest members of its groups, that which it shares most groups with.
   That is one pair for each class, however many groups hold it and however large they are. Pairs whose sketches (minima
   of a byte) agree enough are verified on the full sets, and components are formed. From then on only members outside
   the largest component of a group count, and once more each is compared with one pivot, a member of it.
2. Groups that still hold more than one component are compared exhaustively across components, those outside the group's
   main component against all: small groups at once, larger ones in blocks of bounded size. Groups with more than
   ``PAIRS`` such pairs are split further first, if the caller can do that.
3. By their sketches, each class names its most alike partner elsewhere, if there is one. These pairs are verified first;
   classes that named a partner and are still apart are then compared exhaustively with each other on their full sets,
   again in blocks. Rows grow with the members of groups, never with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, similar

#: Members of a group that is compared at once, and pairs across components of one that is not split further.
SMALL, PAIRS = 128, 1 << 23
#: Members of a block of a large group, and bytes of full sets in one: wider blocks repeat each member less often.
WIDE, WIDE_BYTES = 2_048, 4 << 20


def signature(column: pa.Array, kind: type = np.uint16) -> np.ndarray:
    """The values of a binary column, as many in each, a row each."""
    data = common.raw(column)[0].view(kind)
    return data.reshape(len(column), -1) if len(column) else data.reshape(0, 0)


def _near(sketch: float):
    """Keep (a, b) whose sketches agree enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = pa.array((signature(batch.column(2), np.uint8) == signature(batch.column(3), np.uint8)).mean(axis=1) >= sketch, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def alike(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The share of places at which each of ``rows`` (bytes) equals ``row``: eight places are added at a time."""
    lanes = (rows == row).view(np.uint64).sum(axis=1)  # of up to 255 places each
    wide = (lanes & _EVEN) + (lanes >> np.uint64(8) & _EVEN)
    return (wide * _ONES >> np.uint64(48)).astype(np.float64) / rows.shape[1]


_EVEN, _ONES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


class _Block:
    """One group of members: side 0 is a whole node, 1 holds those outside the main component, 2 those that meet them."""

    def __init__(self, members: pa.StructArray, sketch: float):
        self.sketch = sketch
        self.node, self.root, self.side = (members.field(x).to_numpy(zero_copy_only=False) for x in ("node", "root", "side"))
        self.fine = signature(members.field("fine"), np.uint8)
        self.left, self.right = np.flatnonzero(self.side != 2), np.flatnonzero(self.side != 1)
        self.whole = not self.side.any()

    def likeness(self):
        """For each left member (its place, likeness to each right member, 0 within a component and below the least share)."""
        theirs, roots = self.fine[self.right], self.root[self.right]
        for x in self.left.tolist():
            like = alike(theirs, self.fine[x])
            like[(like < self.sketch) | (roots == self.root[x])] = 0
            yield x, like


def _groups(batches, column: str):
    """(row, members) of the groups of a batch, one at a time."""
    for batch in batches:
        groups = batch.column(batch.schema.get_field_index(column))
        for k in range(batch.num_rows):
            yield batch.slice(k, 1), groups[k].values


def _across(sketch: float):
    """For each member of a block with an alike partner in another component: the most alike one."""
    return lambda batches: (found for row, members in _groups(batches, "group") if (found := _partners(row, _Block(members, sketch))) is not None)


def _partners(row: pa.RecordBatch, block: _Block) -> pa.RecordBatch | None:
    best, partner = np.zeros(len(block.node)), np.full(len(block.node), -1)
    for x, like in block.likeness():
        if not len(like):
            break
        j = int(like.argmax())
        if like[j] > best[x]:
            best[x], partner[x] = like[j], block.right[j]
        if not block.whole:
            more = like > best[block.right]
            best[block.right[more]], partner[block.right[more]] = like[more], x
    at = np.flatnonzero(partner >= 0)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([pa.array(block.node[at]), pa.array(block.node[partner[at]]), pa.array(best[at]), pa.array(np.full(len(at), row.column(0)[0].as_py()))], names=["node", "partner", "like", "main"])


def _exactly(percent: int, sketch: float):
    """Links of a block on full sets: for each left member one to each other component at most."""

    def run(batches):
        for _, members in _groups(batches, "group"):
            block, items = _Block(members, sketch), members.field("items")
            own = lambda i: np.frombuffer(items[int(i)].as_buffer(), np.uint64)  # noqa: E731, B023
            a, b = [], []
            for x, like in block.likeness():
                done: set[int] = set()
                for j in np.argsort(-like, kind="stable")[: np.count_nonzero(like)].tolist():
                    y = int(block.right[j])
                    if block.root[y] not in done and similar.linked(own(x), own(y), percent):
                        done.add(block.root[y])
                        a.append(min(block.node[x], block.node[y]))
                        b.append(max(block.node[x], block.node[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _blocks(members: DataFrame, key: str, small: int, weight=None, limit: int = 1) -> DataFrame:
    """Members of each ``key`` (with ``minor``) dealt to blocks of about ``small`` minor members, and ``limit`` of ``weight``, by as many of all: (key, i, j, ..., side)."""

    def blocks(n, w):
        return F.ceil(n / small) if weight is None else F.greatest(F.ceil(n / small), F.ceil(w / limit))

    w = F.lit(0) if weight is None else weight
    sizes = members.groupBy(key).agg(blocks(F.count_if("minor"), F.sum(F.when(F.col("minor"), w))).alias("mb"), blocks(F.count("*"), F.sum(w)).alias("nb"))
    rows = members.join(common.materialize(sizes, "sizes", True), key)
    block = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    anyone = rows.withColumn("j", block % F.col("nb")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1))).withColumn("side", F.lit(2))
    outside = rows.where("minor").withColumn("i", block % F.col("mb")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("side", F.lit(1))
    return anyone.unionByName(outside)


def _grouped(members: DataFrame) -> DataFrame:
    """(path, node, n, pivot): members of nodes with more than one class, the size of the node and its smallest class.

    The sizes are written first, so that the join meets two exchanges and Spark can split a node that is large.
    """
    least = common.materialize(members.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "nodes", True)
    return members.join(least, "path")


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, node, n, root, minors, main, pivot) of the nodes with more than one component.

    ``main`` is the largest of them, ``pivot`` one of its members, ``minors`` the number of members outside it.
    """
    named = members.select("path", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = named.groupBy("path", "root").agg(F.count("*").alias("m"), F.min_by("node", F.xxhash64("node")).alias("one"))
    mixed = sums.groupBy("path").agg(F.count("*").alias("parts"), (F.sum("m") - F.max("m")).alias("minors"), F.max_by(F.struct("root", "one"), F.struct("m", "root")).alias("top")).where("parts > 1")
    mixed = common.materialize(mixed.select("path", "minors", F.col("top.root").alias("main"), F.col("top.one").alias("pivot")), "nodes", True)
    return named.join(mixed, "path")


def roots_of(level: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, sketch: float, small: int = SMALL, wide: int = WIDE, pairs: int = PAIRS, deeper: Callable[[DataFrame, int], DataFrame | None] = lambda level, k: None) -> DataFrame:
    """(node, root) of the components that verified links make among ``classes`` (node, rep, fine) that are in one group.

    ``level`` has distinct (path, node). ``sketch`` is the least share of equal sketch bytes for a pair to be verified.
    ``deeper`` splits groups with too many pairs: from their members (path, node) and the number of the round it makes
    other ones, or None.
    """
    fine = classes.select("node", "fine")

    def stars(members: DataFrame) -> DataFrame:
        """Links of members to one pivot each, that which they share most groups with."""
        met = members.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("m"))
        asked = met.groupBy("node").agg(F.max_by("pivot", F.struct("m", "pivot")).alias("pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        asked = common.materialize(asked.distinct(), "stars", True)
        both = asked.join(fine.select(F.col("node").alias("a"), F.col("fine").alias("x")), "a").join(fine.select(F.col("node").alias("b"), F.col("fine").alias("y")), "b").select("a", "b", "x", "y")
        return similar.jaccard_links(common.materialize(both.mapInArrow(_near(sketch), "a long, b long"), "pairs"), classes, docs, width, percent)

    def mixed(level: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members of groups with several components, roots) after those outside the main one met a pivot of it."""
        level = common.materialize(_named(level, roots), "mixed")
        roots = similar.extend(roots, stars(level.where("root <> main")))
        return common.materialize(_named(level, roots), "mixed"), roots

    level = common.materialize(_grouped(level), "paths")
    roots = common.materialize(similar.components(stars(level)), "roots", True)
    level, roots = mixed(level, roots)
    leaf = F.col("n") * F.col("minors") <= pairs
    rest, k = level.where(leaf), 0
    level = level.where(~leaf)
    while not level.isEmpty() and (split := deeper(level.select("path", "node"), k)) is not None:
        level, roots = mixed(common.materialize(_grouped(common.materialize(split, "paths")), "paths"), roots)
        rest, k = rest.unionByName(level.where(leaf)), k + 1
        level = level.where(~leaf)

    # what is left: groups that hold several components, and those that had many pairs to the end
    member = F.collect_list(F.struct("node", "root", "fine", "side")).alias("group")
    rest = common.materialize(_named(rest.unionByName(level), roots), "rest")
    near = rest.where(F.col("n") <= small).join(fine, "node").withColumn("side", F.lit(0)).groupBy("path").agg(F.first("main").alias("main"), member)
    big = _blocks(rest.where(F.col("n") > small).withColumn("minor", F.col("root") != F.col("main")).select("path", "node", "root", "main", "minor"), "path", wide)
    blocked = big.join(fine, "node").groupBy("path", "i", "j").agg(F.first("main").alias("main"), member)
    named = near.select("main", "group").union(blocked.select("main", "group")).mapInArrow(common.tidy(_across(sketch)), "node long, partner long, like double, main long")
    named = common.materialize(named.groupBy("node", "main").agg(F.max_by("partner", F.struct("like", "partner")).alias("partner")), "partners")
    asked = named.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()
    roots = similar.extend(roots, similar.jaccard_links(common.materialize(asked, "pairs", True), classes, docs, width, percent))

    # classes that named a partner and are still apart, on their full sets
    apart = named.select("node", "main").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    centre = roots.select(F.col("node").alias("main"), F.col("root").alias("centre"))
    apart = apart.join(centre, "main", "left").select(F.coalesce("centre", "main").alias("main"), "node", "root").distinct()
    several = apart.groupBy("main").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("main")
    apart = common.materialize(apart.join(several, "main", "left_semi").withColumn("minor", F.col("root") != F.col("main")), "apart", True)
    if apart.isEmpty():
        return roots
    items = similar.full_sets(apart.select("node").distinct(), classes, docs, width)
    sized = common.materialize(apart.join(items.select("node", F.octet_length("items").alias("bytes")), "node"), "sized", True)
    blocks = _blocks(sized, "main", wide, F.col("bytes"), WIDE_BYTES).join(fine, "node").join(items, "node").groupBy("main", "i", "j").agg(F.collect_list(F.struct("node", "root", "fine", "items", "side")).alias("group"))
    return similar.extend(roots, common.materialize(blocks.select("group").mapInArrow(common.tidy(_exactly(percent, sketch)), "a long, b long"), "links"))
