"""Near-duplicates by a chosen-path set similarity join.

1. Every distinct shingle set gets a signature of 256 minwise tokens; equal sets are one class from the start.
2. Independent trees branch the classes: a node of a tree picks, by its own name, one or two of the 256 places (1.25 on
   average, the inverse of the threshold), and a class goes on to the child named by the place and its minwise token
   there. Classes that share much stay together on some path, others part quickly. Paths of ``TREES`` trees of two
   levels are computed without communication.
3. Nodes are compared exhaustively, without emitting pairs (see ``groups``). Classes in nodes with too many pairs across
   components take part in ``DEEP`` other trees of four and, where that is still so, six levels: as more pairs part on a
   longer path, it takes more trees to keep them.

A pair of similarity 0.8 meets in a tree of two levels with probability about 0.73, of six with 0.48. All trees draw from
the same 256 places; with that, it is missed by twelve trees of two levels with probability about 4e-7, and by 28 of six
with 4e-7 as well. All intermediate tables are files in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups, similar

WIDTH, PERCENT = 4, 80
TREES, DEEP = 12, 28
ROUNDS = 2
FINE = 256
#: Least share of equal minima for a pair to be verified; one of similarity 0.8 falls short (six deviations) about once in 10^9.
SKETCH = 0.65


def branch(path: np.ndarray, sig: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """One level: (row, name of the child) for each row's one or two children."""
    many = np.uint64(sig.shape[1])
    rows = np.arange(len(path))
    one = (similar.mix(path ^ np.uint64(0xA5A5)) % many).astype(np.int64)
    two = (similar.mix(path ^ np.uint64(0x5A5A5)) % many).astype(np.int64)
    more = similar.mix(path ^ np.uint64(0x777777)) < np.uint64(min(2**64 - 1, int((100 / percent - 1) * 2**64)))
    more &= one != two
    row = np.concatenate([rows, rows[more]])
    place = np.concatenate([one, two[more]])
    return row, similar.mix(path[row] * np.uint64(0x9E3779B97F4A7C15) + similar.mix(place.astype(np.uint64) << np.uint64(32) | sig[row, place]))


def paths(sig: np.ndarray, first: int, trees: int, levels: int, percent: int = PERCENT):
    """For each of ``trees`` trees from number ``first``: (row, name of a node at that level) for the rows of ``sig``."""
    for tree in range(first, first + trees):
        row, path = np.arange(len(sig)), np.full(len(sig), similar.mix(np.array([tree + 1], np.uint64))[0])
        for _ in range(levels):
            again, path = branch(path, sig[row], percent)
            row = row[again]
        yield row, path


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, node (name of its shingle set, null if empty), sig (for branching), fine (for comparing)."""

    def run(batches):
        common.forget()
        for batch in common.text_slices(batches, limit=2 * similar.STRETCH):
            hashes, begin = similar.shingles(batch.column(1), width)
            found = similar.sets(hashes, begin)
            minima = similar.signatures(hashes, begin, FINE)
            sig, fine = minima.astype(np.uint16), minima.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([similar.set_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in fine], pa.binary())], names=["doc_id", "n_shingles", "node", "sig", "fine"])

    return common.id_text(docs).mapInArrow(common.tidy(run), "doc_id long, n_shingles long, node long, sig binary, fine binary")


def _rooted(first: int, trees: int, levels: int, percent: int):
    def run(batches):
        for batch in batches:
            sig, nodes = groups.signature(batch.column(1)), batch.column(0)
            for row, path in paths(sig, first, trees, levels, percent):
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), nodes.take(pa.array(row))], names=["path", "node"])

    return run


def _deeper(percent: int):
    def run(batches):
        for batch in batches:
            sig, path = groups.signature(batch.column(2)), batch.column(0).to_numpy().view(np.uint64)
            row, path = branch(path, sig, percent)
            again, path = branch(path, sig[row], percent)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(1).take(pa.array(row[again]))], names=["path", "node"])

    return run


def roots_of(classes: DataFrame, docs: DataFrame, width: int, percent: int, trees: int, small: int = groups.SMALL, rounds: int = ROUNDS, wide: int = groups.WIDE, pairs: int = groups.PAIRS) -> DataFrame:
    """(node, root) of the components that verified links make among ``classes`` (node, rep, sig, fine)."""
    sigs = classes.select("node", "sig")

    def deeper(level: DataFrame, k: int) -> DataFrame | None:
        if k == rounds:
            return None
        if k == 0:  # other trees, as it takes more of them at this depth
            return level.select("node").distinct().join(sigs, "node").select("node", "sig").mapInArrow(_rooted(trees, DEEP, 4, percent), "path long, node long").distinct()
        return level.join(sigs, "node").select("path", "node", "sig").mapInArrow(_deeper(percent), "path long, node long").distinct()

    level = sigs.mapInArrow(_rooted(0, trees, 2, percent), "path long, node long").distinct()
    return groups.roots_of(level, classes, docs, width, percent, SKETCH, small, wide, pairs, deeper)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have the empty set and are linked with nothing. Rows that repeat an id are documents of
    their own. A row without id is never in a component of its own: its ``component_id`` is the smallest id that it
    reaches, or null, and it is kept only if that is null. An empty table gives no rows.
    """
    common.ready(docs.sparkSession)
    profile = common.materialize(profiles(docs, width), "profiles")
    classes = common.materialize(profile.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("fine").alias("fine")), "classes")
    roots = roots_of(classes, docs, width, percent, trees)
    named = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = common.materialize(named.join(smallest, "root").select("node", "component_id"), "found", True)
    out = profile.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept, with all their columns: of each group the one with the smallest id.

    An id goes if all its rows do, so repeated rows stay together; rows without id stay. The ids to drop are sent to
    all executors up to ``similar.BROADCAST_IDS`` of them, else joined by a shuffle.
    """
    gone = near_duplicates(docs, width, percent).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__gone"))
    gone = common.materialize(gone, "gone", True)
    if gone.count() <= similar.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
