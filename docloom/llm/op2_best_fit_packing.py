"""Best-fit packing planned over a histogram of lengths.

1. A narrow Python step encodes every document, cuts only what is longer than a sequence, and numbers the pieces of
   each length inside its own task (``local``); the rows are written once to the shared folder.
2. Counts by length, at most one row for each possible length, go to the driver, which runs best-fit decreasing over
   counts: equal bins are kept as ranges, so the plan has a few rows for each length however many documents there are.
3. The rank of a piece within its length is its task's offset plus ``local``; it takes its slot by joining the plan on
   length and rank. No task holds all pieces of a length, so a hot length is as harmless as any other.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
END = 0
#: Chunks that a worker holds, and that it still holds after a task, as it may wait long for the next one.
MEMO, KEPT = 200_000, 100_000
#: Above this many rows the plan is joined by a shuffle.
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """Each document's ids and ``end``, cut after every ``size`` ids; ``local`` numbers a task's pieces of one length."""

    def cut(batches):
        enc, seen, task = common.encoder(common.vocabulary(vocabulary), MEMO), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in common.text_slices(batches, limit=2 << 20):
            flat, begin = enc.ids(batch.column(1))
            n = len(begin) - 1
            flat = np.insert(flat, begin[1:], end).astype("<u4")
            begin = begin + np.arange(n + 1)
            many = -(-np.diff(begin) // size)
            doc = np.repeat(np.arange(n), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            low = begin[doc] + piece * size
            high = np.minimum(low + size, begin[doc + 1])
            length = high - low
            view = memoryview(flat).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.int64, len(low))
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            local = np.empty(len(order), np.int64)
            local[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), task), pa.int32()), pa.array(local)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"],
            )
        enc.keep(KEPT)

    return common.id_text(docs).mapInArrow(common.tidy(cut), PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, first rank, end rank, first sequence, pieces for each sequence, offset).

    A piece takes the sequence with the least room that fits. That sequence then has the least room again, so a whole
    range of equal sequences takes as many pieces of a length as fit before the next range is looked at.
    """
    rooms: list[int] = []  # sorted; ranges[r] holds the sequences with room r
    ranges: dict[int, list[tuple[int, int]]] = {}
    out, fresh = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, many))

    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, first = size, fresh
                many = -(-left // (size // length))
                fresh += many
            else:
                room = rooms[at]
                first, many = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            fit = room // length
            full = min(many, left // fit)
            if full:
                out.append((length, rank, rank + full * fit, first, fit, size - room))
                put(room - fit * length, first, full)
                rank, left, first, many = rank + full * fit, left - full * fit, first + full, many - full
            if left and many:
                out.append((length, rank, rank + left, first, left, size - room))
                put(room - left * length, first, 1)
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            put(room, first, many)
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null, empty and blank texts give one piece of the end id alone. Texts longer than ``size`` ids give full pieces and
    a rest. Repeated rows are packed each; an empty table gives no rows.
    """
    spark = common.ready(docs.sparkSession)
    cut = common.materialize(pieces(docs, vocabulary, size, end), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots = plan(counts, size)
    planned = spark.createDataFrame(slots, "length long, low long, high long, first long, each long, base long")
    if len(slots) <= BROADCAST_ROWS:
        planned = F.broadcast(planned)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = cut.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("local"))
    placed = ranked.join(planned, (ranked["length"] == planned["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(planned["length"])
    inside = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("base") + inside % F.col("each") * F.col("length")).alias("offset"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
