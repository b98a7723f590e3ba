"""What the operators share: documents in Arrow batches, shared storage, global order, and chunk-wise encoding.

Conventions for every operator of this subpackage:

* a null text counts as the empty text, unless the operator says otherwise;
* a null ``doc_id`` sorts first and is returned as null;
* repeated rows are kept, one result for each;
* only ``doc_id`` and ``text`` are read, so other columns of any name are ignored;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import materialize  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of text that one vectorised step of a Python worker takes, so that its memory is bounded.
SLICE_BYTES = 6 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of files that one range of ids should not exceed, and the number of ranges up to which bounds are looked up in the plan.
RANGE_BYTES, MOST_RANGES = 256 << 20, 4_096


# ---------------------------------------------------------------- session and storage


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where its folder exists on their machine, and keep Arrow batches small.

    A batch is held by the executor, by Arrow outside its heap and by the worker; one of ``SLICE_BYTES`` is what a
    vectorised step takes. A session with a limit of its own keeps it.
    """
    if spark.conf.get(_BATCH) == "67108864b":  # the default
        spark.conf.set(_BATCH, f"{SLICE_BYTES}b")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.spread(ready(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(docs: DataFrame) -> int:
    """How many ranges ``docs`` are dealt to: as many as there are shuffle partitions, and more where those would exceed ``RANGE_BYTES``.

    The size is Spark's own estimate from the files behind the plan, so nothing is read for it; a plan without one counts
    as small.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), min(MOST_RANGES, -(-size // RANGE_BYTES)) if size < 1 << 60 else 1)


def in_order(docs: DataFrame, *, ahead: bool = False) -> tuple[DataFrame, int]:
    """Deal rows out by ranges of ``doc_id``, sorted inside each: returns (rows with ``shard``, number of shards).

    Rows that repeat one id, or have none, share a range, as their order is one. The bounds are ids that occur, from approximate percentiles over a scan of the id column alone, so the text is moved
    only once. With ``ahead``, the rows of the first id of each shard also go to the shard before it (``ahead`` true,
    sorted last), and those of the smallest id to the last shard: each row then finds its successor in its own shard.
    Their number is bounded by the number of shards (times the repeats of one id).
    """
    n = ranges(docs)
    steps = [k / n for k in range(1, n)]
    got = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", F.lit([float(x) for x in steps] or [0.5]), F.lit(10 * n + 1000)).alias("cuts")).first()
    if got["low"] is None:
        bounds: list[int] = []
    else:
        bounds = sorted({x for x in (got["cuts"] or []) if x is not None and x > got["low"]}) if steps else []
    total = len(bounds) + 1
    at = _shard_of(bounds)
    rows = docs.withColumn("shard", at)
    if ahead:
        first = F.col("doc_id").isNull()
        if got["low"] is not None:
            first = first | F.col("doc_id").isin([*bounds, got["low"]])
        if total == 1:
            before = F.lit(0)
        else:
            before = F.when(F.col("shard") == 0, F.lit(total - 1)).otherwise(F.col("shard") - 1)
        two = F.array(F.struct(F.col("shard").alias("shard"), F.lit(False).alias("ahead")), F.struct(before.cast("int").alias("shard"), F.lit(True).alias("ahead")))
        one = F.array(F.struct(F.col("shard").alias("shard"), F.lit(False).alias("ahead")))
        rows = rows.withColumn("shard", F.explode(F.when(first, two).otherwise(one))).select(*docs.columns, F.col("shard.shard").alias("shard"), F.col("shard.ahead").alias("ahead"))
    return rows.repartitionById(total, F.col("shard").cast("int")), total


def _shard_of(bounds: list[int]):
    """The number of bounds at or below ``doc_id``, by binary search in nested conditions."""

    def search(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") >= F.lit(bounds[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds)).cast("int")


# ---------------------------------------------------------------- texts in Arrow


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of ``column`` or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, offsets = raw(col)
        if offsets[-1] - offsets[0] <= limit:
            yield batch
            continue
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = max(at + 1, min(end, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and ends; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings between neighbouring bounds, without a copy."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


# ---------------------------------------------------------------- chunk-wise encoding

#: Classes of bytes: a blank or line feed, visible ASCII, a letter, a stop, the first byte of U+00C0 to U+00FF.
_GAP, _SEEN, _LETTER, _STOP, _LEAD = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[10, 32]] = _GAP
_KIND[0x21:0x7F] = _SEEN
_KIND[[x for x in range(0x41, 0x7B) if chr(x).isalpha()]] |= _LETTER
_KIND[[ord(x) for x in ",.;:!?"]] |= _STOP
_KIND[0xC3] = _LEAD
#: What a second byte after the first byte C3 makes: visible, and a letter but for the signs of times and division.
_AFTER_C3 = np.zeros(256, np.uint8)
_AFTER_C3[0x80:0xC0] = _SEEN | _LETTER
_AFTER_C3[[0x97, 0xB7]] = _SEEN
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where texts can be cut without changing what a tokenizer of either kind makes of them.

    These are the starts of the texts; a single blank, or a line feed and what follows it, between visible characters;
    and a stop right after a letter. Both kinds begin a new piece there, and neither merges across pieces. Visible
    means ASCII or the letters of Latin-1, as other bytes could be part of a wider space.
    """
    n = len(data)
    starts = offsets[:-1][np.diff(offsets) > 0]
    if n < 3:
        return np.unique(starts)
    kind = _KIND[data]
    before = kind[:-1] | (_AFTER_C3[data[:-1]] * np.concatenate([[False], data[:-2] == 0xC3]))  # of the character that ends there
    mark = np.zeros(n, bool)
    mark[1:-1] = ((kind[1:-1] & _GAP) > 0) & ((before[:-1] & _SEEN) > 0) & ((kind[2:] & (_SEEN | _LEAD)) > 0)
    line = mark & (data == 10)
    mark[1:] |= ((kind[1:] & _STOP) > 0) & ((before & _LETTER) > 0)
    mark[1:] |= line[:-1]
    mark[starts] = True
    # the neighbour may lie in another text: a cut before a last blank or after a first line feed is right as well
    return np.flatnonzero(mark)


_PLAIN = re.compile(r" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+")


class Chunks:
    """Encodes texts chunk by chunk, each distinct chunk once; a memo of bounded size keeps chunks from batch to batch."""

    MEMO = 600_000
    lower = False

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 18, np.int64)
        self.uses = np.zeros(1 << 18, np.int32)  # batches that a chunk was in
        self.held = 0

    def keep(self, most: int) -> None:
        """Make room: keep the chunks that were in more than one batch, and of those at most ``most`` that were in most."""
        names = list(self.memo)
        places = np.fromiter(self.memo.values(), np.int64, len(names))
        uses, least = self.uses[places], 2
        while np.count_nonzero(uses >= least) > most:
            least += max(1, least // 4)
        keep = np.flatnonzero(uses >= least)
        flat, begin = spread(places[keep], self.flat, self.begin, np.arange(len(keep) + 1))
        self.forget()
        self._add([names[i] for i in keep.tolist()], np.arange(len(keep)), flat, np.diff(begin))

    def _add(self, names: list[bytes], order, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put ``names`` in the memo, which come in ``order`` with their ids; returns their places."""
        held, end = self.held, int(self.begin[self.held])
        while len(self.begin) < held + len(names) + 1:
            self.begin, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.uses))
        while len(self.flat) < end + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[end : end + len(flat)] = flat
        self.begin[held + 1 : held + len(names) + 1] = end + np.cumsum(sizes)
        places = np.empty(len(names), np.int64)
        places[order] = np.arange(held, held + len(names))
        self.memo.update(zip(names, places.tolist(), strict=True))
        self.held += len(names)
        return places

    def _fresh(self, chunks: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order in which the chunks come, their ids one after another, how many each has)."""
        raise NotImplementedError

    def distinct(self, chunks: pa.Array) -> np.ndarray:
        """The places in the memo of the distinct ``chunks``."""
        keys = chunks.to_pylist()
        if len(self.memo) + len(keys) > self.MEMO:
            self.keep(self.MEMO // 2)
        memo = self.memo
        found = np.fromiter(map(memo.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [keys[i] for i in new.tolist()]
            found[new] = self._add(names, *self._fresh([x.decode("utf-8") for x in names]))
        self.uses[found] += 1
        return found

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the place in the memo of each chunk, where each text's chunks begin)."""
        data, offsets = raw(texts)
        if self.lower and b"<|" not in data.tobytes():  # special strings are told apart by case
            data = _LOWER[data]
        at = cuts(data, offsets)
        words = strings(data, np.append(at, len(data))).dictionary_encode()
        return self.distinct(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)], np.searchsorted(at, offsets)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        places, docs = self.chunked(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(self.begin[: self.held + 1])[places])])
        return np.diff(total[docs])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin."""
        places, docs = self.chunked(texts)
        return spread(places, self.flat, self.begin, docs)


class Encoder(Chunks):
    """Encodes with a file of the tokenizers library.

    Distinct chunks that are one word are joined to long strings for a few calls of the library; where each ends is
    seen from its tokens (words end in ``</w>`` or begin with a blank). All others are encoded one by one.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.lower = self.words = any(x.endswith("</w>") for x in vocab)
        self.edge = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for x, i in vocab.items():
            self.edge[i] = x.endswith("</w>") if self.words else x.startswith("Ġ")
        del vocab
        give_back()  # reading the file takes several times its size

    def _fresh(self, chunks: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order in which the chunks come, their ids one after another, how many each has)."""
        plain, odd = [], []
        match, blank = _PLAIN.fullmatch, self.words
        for i, x in enumerate(chunks):
            (plain if len(x) < 64 and match(x) and (blank or x[0] == " ") else odd).append(i)
        flats, sizes, order = [], [], []
        sep = " " if self.words else ""
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, found in zip(part, self.tok.encode_batch_fast([sep.join([chunks[i] for i in g]) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.uint32)
                where = np.flatnonzero(self.edge[ids])
                if len(where) != len(group):
                    odd.extend(group)
                    continue
                flats.append(ids)
                sizes.append(np.diff(where, prepend=-1) if self.words else np.diff(where, append=len(ids)))
                order.extend(group)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            found = [x.ids for x in self.tok.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)]
            flats.append(np.array([y for x in found for y in x], np.uint32))
            sizes.append(np.array([len(x) for x in found], np.int64))
            order.extend(part)
        none = [np.zeros(0, np.int64)]
        return order, np.concatenate([np.zeros(0, np.uint32), *flats]), np.concatenate(none + sizes)


def spread(places: np.ndarray, flat: np.ndarray, begin: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write out the stretch of ``flat`` at each place; ``docs`` holds where each text's places begin."""
    start = begin[places]
    lengths = begin[places + 1] - start
    total = np.concatenate([[0], np.cumsum(lengths)])
    start -= total[:-1]
    where = np.repeat(start, lengths)
    where += np.arange(total[-1])
    return flat[where], total[docs]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memo: int = Chunks.MEMO) -> Encoder:
    """One encoder for each file and worker process, with room for ``memo`` chunks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].MEMO = memo
    return _ENCODERS[path]


def give_back() -> None:
    """Return unused memory to the system: Python, Arrow and the C library keep what they have freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of GNU can be asked so
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Free what this worker holds for encoding, before work that needs none of it."""
    _ENCODERS.clear()
    give_back()


def tidy(run):
    """``run`` over batches, and unused memory given back at its end, as an idle worker may wait long beside others."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine; looked up where it is used, as each worker has its own."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
