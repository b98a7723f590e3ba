"""Token ids in files compressed by a grammar (Re-Pair), with random access.

Documents are dealt out by ranges of ``doc_id`` and encoded; about ``TARGET`` ids, whole documents each, make a shard.
In a shard, rounds replace the most frequent pairs of neighbouring symbols by new symbols (nonterminals): pairs are
counted in hashed bins, one pair of each of the fullest bins is then counted exactly, and where two chosen pairs overlap
the more frequent one wins. Pairs never cross the end of a document. Rounds go on until no pair occurs ``LEAST`` times, the
symbols of 16 bits are used up, or a round shortens the shard by less than ``GAIN``.

The expansion length of each rule is stored: lengths and starts of documents come from sums over their symbols alone, and
``Shard.ids`` decodes any stretch of a document from the symbols that cover it.

A shard is one value of bytes, little-endian:

    "DLRP"  version u4  n_docs u4  n_rules u4  n_symbols u8  base u4  end u4
    rules u4[n_rules][2]      symbol ``base + 1 + k`` stands for the two symbols of rule k
    sizes u4[n_rules]         ids that rule k expands to
    ids i8[n_docs]  null u1[n_docs]
    at u8[n_docs + 1]         first symbol of each document
    symbols u2[n_symbols]     below ``base`` an id, ``base`` the end of a document, above it a rule

Shards lie in the rows of a Parquet table (shard, block, first and last id, number of documents and ids, bytes): any
store that Spark reaches holds it, Spark's commit protocol drops what a lost task wrote, and a scan of the other
columns finds the shard of a document without reading bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.json"
END = 2
BASE = 50_257
TARGET = 1_500_000
RULES_A_ROUND, LEAST, GAIN = 8_192, 8, 0.005
#: Chunks that a worker holds.
MEMO = 1_000_000
_BINS = 18
HEAD = struct.Struct("<4sIIIQII")
FILES = "shard int, block int, first_id long, last_id long, n_docs long, n_ids long, content binary"


# ---------------------------------------------------------------- grammar


def compress(seq: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a sequence of symbols up to ``base``, which no rule takes in."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    fresh = base + 1
    while (room := min(RULES_A_ROUND, 65_536 - fresh)) > 0 and len(seq) >= 2 * LEAST:
        pair = seq[:-1] << np.uint32(16) | seq[1:]
        free = (seq[:-1] != base) & (seq[1:] != base)
        hashed = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BINS)).astype(np.int32)
        full = np.bincount(hashed[free], minlength=1 << _BINS)
        least = max(LEAST, int(np.partition(full, -room)[-room]))
        top = np.flatnonzero(full >= least)
        number = np.full(1 << _BINS, -1, np.int32)
        number[top] = np.arange(len(top))
        codes = number[hashed]
        where = np.flatnonzero((codes >= 0) & free)
        codes, some = codes[where], pair[where]
        keys = np.zeros(len(top), np.uint32)
        keys[codes] = some  # one pair of each bin, more likely a frequent one; another in the same bin waits for a later round
        own = keys[codes] == some
        where, codes = where[own], codes[own]
        many = np.bincount(codes, minlength=len(top))
        best = np.argsort(-many, kind="stable")[:room]
        best = best[many[best] >= LEAST]
        rank = np.full(len(keys), 1 << 30, np.int32)
        rank[best] = np.arange(len(best))
        chosen, rank_at = _apart(where, rank[codes])
        used = np.bincount(rank_at, minlength=len(best))
        keep = used >= LEAST  # the others gave way to more frequent pairs; their places stay as they are
        name = np.cumsum(keep) - 1
        ok = keep[rank_at] if len(rank_at) else np.zeros(0, bool)
        chosen, rank_at = chosen[ok], rank_at[ok]
        if not len(chosen):
            break
        taken = keys[best[keep]]
        rules.append(np.stack([taken >> np.uint32(16), taken & np.uint32(0xFFFF)], 1))
        seq[chosen] = fresh + name[rank_at]
        stay = np.ones(len(seq), bool)
        stay[chosen + 1] = False
        seq = seq[stay]
        fresh += int(keep.sum())
        if len(chosen) < GAIN * len(stay):
            break
    return seq, np.concatenate([np.zeros((0, 2), np.uint32), *rules])


def _apart(where: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, none next to another, by lower rank first and then from the left."""
    live = rank < (1 << 30)
    where, rank = where[live], rank[live]
    out, ranks = [], []
    for _ in range(4):
        if not len(where):
            break
        near = np.diff(where) == 1
        left = np.concatenate([[1 << 30], np.where(near, rank[:-1], 1 << 30)])
        right = np.concatenate([np.where(near, rank[1:], 1 << 30), [1 << 30]])
        win = (rank < left) & (rank <= right)
        out.append(where[win])
        ranks.append(rank[win])
        dead = win.copy()
        dead[1:] |= win[:-1] & near
        dead[:-1] |= win[1:] & near
        where, rank = where[~dead], rank[~dead]
    at, got = np.concatenate([np.zeros(0, np.int64), *out]), np.concatenate([np.zeros(0, np.int32), *ranks])
    order = np.argsort(at, kind="stable")
    return at[order], got[order]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The symbols up to ``base`` that ``symbols`` stand for: each pass writes out all rules by one level."""
    out = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(out > base)):
        two = rules[out[at] - (base + 1)]
        out = np.repeat(out, np.where(out > base, 2, 1))
        at = at + np.arange(len(at))
        out[at], out[at + 1] = two[:, 0], two[:, 1]
    return out


def write_shard(doc_ids: list, ids: np.ndarray, begin: np.ndarray, end: int = END, base: int = BASE) -> bytes:
    """The bytes of a shard with the given documents; ``ids`` are without their end."""
    seq, rules = compress(np.insert(ids, begin[1:], base).astype(np.uint32), base)
    size = [1] * (base + 1)
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    at = np.concatenate([[0], np.flatnonzero(seq == base) + 1])
    return b"".join([
        HEAD.pack(b"DLRP", 1, len(doc_ids), len(rules), len(seq), base, end),
        rules.astype("<u4").tobytes(), np.array(size[base + 1 :], "<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
        at.astype("<u8").tobytes(), seq.astype("<u2").tobytes(),
    ])


class Shard:
    """Reads a shard; ``ids`` expands only the symbols that cover a stretch of one document."""

    def __init__(self, content: bytes):
        magic, version, docs, rules, symbols, self.base, self.end = HEAD.unpack_from(content)
        if (magic, version) != (b"DLRP", 1):
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, many: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, many, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.sizes = take("<u4", rules)
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.at = take("<u8", docs + 1).astype(np.int64)
        self.symbols = take("<u2", symbols)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for, from the stored lengths."""
        return np.concatenate([np.ones(self.base + 1, np.int64), self.sizes])[symbols]

    def begin(self) -> np.ndarray:
        """Where each document's ids begin among all, and their number, without decoding."""
        return np.concatenate([[0], np.cumsum(self.lengths(self.symbols))])[self.at]

    def _ended(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.base, np.uint32(self.end), ids)

    def ids(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``, its end id included."""
        part = self.symbols[self.at[k] : self.at[k + 1]]
        edges = np.concatenate([[0], np.cumsum(self.lengths(part))])
        stop = int(edges[-1]) if stop is None else min(stop, int(edges[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = int(np.searchsorted(edges, start, side="right")) - 1, int(np.searchsorted(edges, stop))
        return self._ended(expand(part[low:high], self.rules, self.base))[start - edges[low] : stop - edges[low]]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin."""
        size = np.concatenate([np.arange(self.base + 1), np.arange(len(self.rules)) + self.base + 1])
        flat = expand(size, self.rules, self.base)
        edges = np.concatenate([[0], np.cumsum(self.lengths(size))])
        return common.spread(self.symbols, self._ended(flat), edges, self.at)


# ---------------------------------------------------------------- files


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, base: int = BASE, target: int = TARGET) -> DataFrame:
    """The table of shards (see above), blocks in ascending order of ``doc_id``."""
    rows, _ = common.in_order(common.id_text(docs))

    def pack(batches):
        enc = common.encoder(common.vocabulary(vocabulary), MEMO)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        count = block = shard = 0

        def flush():
            ids = np.concatenate([x for _, x, _ in held])
            sizes = np.concatenate([np.diff(b) for _, _, b in held])
            names = [x for d, _, _ in held for x in d]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            known = [x for x in names if x is not None]
            row = [shard, block, min(known, default=None), max(known, default=None), len(names), len(ids) + len(names), write_shard(names, ids, begin, end, base)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()], strict=True)], names=["shard", "block", "first_id", "last_id", "n_docs", "n_ids", "content"])

        for batch in common.text_slices(batches):
            shard = batch.column(2)[0].as_py()
            ids, begin = enc.ids(batch.column(1))
            held.append((batch.column(0).to_pylist(), ids, begin))
            count += len(ids)
            if count >= target:
                yield flush()
                held, count, block = [], 0, block + 1
        if held:
            yield flush()

    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(pack, FILES)


def read_files(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, decoded from the shards.

    ``start`` counts the ids of all documents before it. A null text is empty and has the end id alone. Repeated rows
    are written each, ties by text; null ids come first. An empty table gives no rows.
    """

    def decode(batches):
        for batch in batches:
            for shard, block, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                read = Shard(content)
                (ids, ends), begin = read.all(), read.begin()
                if not np.array_equal(ends, begin):
                    raise ValueError(f"block {block} of shard {shard}: expansion lengths and ids disagree")
                view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B") if len(ids) else b""
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(read.doc_ids, pa.int64()), pa.array(begin[:-1]), pa.array(np.diff(begin)), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = files.select("shard", "block", "content").mapInArrow(decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range of ids
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    blocks = files.select("shard", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("before")).join(shards, "shard")
    return found.join(blocks, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(common.materialize(token_files(common.documents(spark, sf_dir)), "token_files"))
