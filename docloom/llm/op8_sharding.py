"""Sharding by a keyed permutation: Feistel rounds with cycle walking over global row numbers.

Rows get global numbers in the order of ``doc_id``; a permutation of those numbers is the shuffled order, and shard and
slot are its remainder and quotient. Anyone who knows the number of rows and the key can compute where row number r
lies, or which row lies in a slot (``invert``), without the data. Only ids, sizes and checksums are moved; the counts
that turn places within a range into global numbers are one row for each range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .similar import mix

SHARDS = 8
KEY = 20_240_601
ROUNDS = 6
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


class Permutation:
    """A permutation of 0 .. n-1, as a function of the key."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.bits = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _rounds(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.bits), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & self.mask)
        return left << np.uint64(self.bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._rounds(np.asarray(x).astype(np.uint64), back)
        while len(far := np.flatnonzero(out >= self.n)):  # under four times the range, so a few steps
            out[far] = self._rounds(out[far], back)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def invert(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def assign(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Counts of the shards differ by one at most. A null text has size 1 and the checksum of no bytes. Null ids come
    first; ties of ``doc_id`` are ordered by checksum and size, so equal rows are interchangeable. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.ready(docs.sparkSession) and docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, total = common.in_order(narrow)
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row for each range
    base, n = {}, 0
    for k in range(total):
        base[k] = n
        n += counts.get(k, 0)

    def place(batches):
        law, at = Permutation(n, key), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            where = law(base[batch.column(3)[0].as_py()] + at + np.arange(batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(["rows"] * len(where)), pa.array((where % shards).astype(np.int32)), pa.array(where // shards), pa.nulls(len(where), pa.int32())],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    return rows.sortWithinPartitions("doc_id", "text_crc32", "size").mapInArrow(place, SCHEMA)


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.documents(spark, sf_dir))
