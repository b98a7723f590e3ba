"""Word shingles, minwise signatures, exact Jaccard on pairs, and connected components, for the near-duplicate operators."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PERMUTATIONS = 64
#: Up to so many ids (8 bytes each) are sent to all executors; more go through a shuffle.
BROADCAST_IDS = 250_000
#: Bytes of text that are hashed at once; the arrays that this takes are some 40 times as large.
STRETCH = 1 << 20
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    key = str(base)
    if len(_POWERS.get(key, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS[key][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and where each text's begin.

    A word's hash is a polynomial over random values of its bytes, from one running sum over a stretch of about
    ``STRETCH`` bytes, so that a long text takes little more memory than its hashes.
    """
    data, offsets = common.raw(texts)
    n = len(data)
    gaps = np.flatnonzero(_GAP[data])
    bounds = [0]
    while n - bounds[-1] > STRETCH and (k := int(np.searchsorted(gaps, bounds[-1] + STRETCH))) < len(gaps):
        bounds.append(int(gaps[k]))
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in zip(bounds, [*bounds[1:], n], strict=True):
        if high > low:
            found, at = _hashed(common._LOWER[data[low:high]], offsets[1:-1] - low)
            hashes.append(found)
            starts.append(at + low)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _hashed(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte); words also end at ``borders``."""
    n = len(data)
    word = ~_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    edge[0], edge[n] = word[0], word[-1]
    inner = borders[(borders > 0) & (borders < n)]
    touching = np.unique(inner[word[inner] & word[inner - 1]])  # words of two texts that meet
    marks = np.flatnonzero(edge)
    if len(touching):
        marks = np.sort(np.concatenate([marks, touching, touching]))
    starts, ends = marks[::2], marks[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(n, _BASE), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(n, _BACK)[starts]), starts


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of ``width`` words, with repeats, and where each text's begin.

    A text with fewer words, but some, has one window of all of them; one without words has none.
    """
    words, begin = word_hashes(texts)
    count = np.diff(begin)
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(many)])
    salt = mix(np.arange(1, width + 1, dtype=np.uint64) * _M2) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    sums = np.zeros(len(words), np.uint64)
    for j in range(width):
        sums += padded[j : j + len(words)] * salt[j]
    where = np.repeat(begin[:-1] - starts[:-1], many) + np.arange(starts[-1])
    out = sums[where]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        part = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            part[has] += words[begin[:-1][short[has]] + j] * salt[j]
        out[starts[:-1][short]] = part + count[short].astype(np.uint64) * _GOLD
    return mix(out), starts


def sets(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text, sorted."""
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        part = np.sort(hashes[a:b])
        out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) > 1 else part)
    return out


def set_key(items: np.ndarray) -> int | None:
    """A 64-bit name of a set; none for the empty set. Among 10^9 sets, 0.03 pairs are expected to share a name."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True) if len(items) else None


def signatures(hashes: np.ndarray, begin: np.ndarray, many: int = PERMUTATIONS, seed: int = 1) -> np.ndarray:
    """One row of ``many`` 32-bit minima for each text, under as many universal hash functions (multiply and shift).

    Texts without hashes have all bits set. Steps take whole texts of some ten thousand hashes, which stay in cache.
    """
    n = len(begin) - 1
    out = np.full((n, many), 0xFFFFFFFF, np.uint32)
    keys = mix(np.arange(1, 2 * many + 1, dtype=np.uint64) + np.uint64(seed << 32))
    a, b = keys[:many] | np.uint64(1), keys[many:]
    full = np.flatnonzero(np.diff(begin) > 0)
    at = 0
    while at < len(full):
        low = begin[full[at]]
        end = max(at + 1, int(np.searchsorted(begin[full], low + 32_768, side="right")) - 1)
        rows = full[at:end]
        part = hashes[low : begin[rows[-1] + 1]]
        first = begin[rows] - low
        box = np.empty(len(part), np.uint64)
        for i in range(many):
            np.multiply(part, a[i], out=box)
            box += b[i]
            out[rows, i] = np.minimum.reduceat(box, first) >> np.uint64(32)
        at = end
    return out


# ---------------------------------------------------------------- exact check and components


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, items) for distinct ``nodes``, and perhaps others: shingle sets of the documents (``rep``) that ``classes`` names."""
    wanted = common.materialize(nodes.join(classes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct(), "wanted", True)
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def make(batches):
        for batch in common.text_slices(batches, limit=2 * STRETCH):
            found = sets(*shingles(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "items"])

    return common.id_text(docs).join(wanted, "doc_id", "left_semi").mapInArrow(common.tidy(make), "node long, items binary")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, items) for distinct ``nodes``: their shingle sets, from the texts of the documents (``rep``) that ``classes`` names."""
    return common.materialize(_sets_of(nodes, classes, docs, width).dropDuplicates(["node"]), "sets")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``100 * shared >= percent * union``."""
    whole = len(_union(p, q))
    return 100 * (len(p) + len(q) - whole) >= percent * whole


def jaccard_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct ``pairs`` (a, b), those whose full shingle sets are alike enough; a link may come twice.

    Only texts of documents in pairs are looked at. A set moves once for each of its pairs, straight to where the pair is
    compared: the key is the pair, so a node with many pairs makes no hot key.
    """
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ends = common.materialize(pairs.select("a", "b", F.posexplode(F.array("a", "b")).alias("side", "node")), "ends", True)
    many = ends.count()
    sides = F.broadcast(ends) if many <= BROADCAST_IDS else ends
    both = _sets_of(ends.select("node").distinct(), classes, docs, width).join(sides, "node").select("a", "b", "side", "items")

    def check(batches):
        key, held = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, side, items in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if side == 0:
                    key, held = (a, b), np.frombuffer(items.as_buffer(), np.uint64)
                elif key == (a, b) and linked(held, np.frombuffer(items.as_buffer(), np.uint64), percent):
                    out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    met = both.repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return common.materialize(met.mapInArrow(common.tidy(check), "a long, b long"), "links")


def _union(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of pairs of nodes, sent to all executors up to ``BROADCAST_IDS`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: ``root`` is the smallest node of its component.

    Large-star and small-star steps alternate until the edges no longer change; each step is a minimum for each node,
    which is combined before the shuffle, and a join on the node (with a broadcast table while there are few edges).
    The number of steps grows with the logarithm of the longest chain, not with its length.
    """
    now = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", True)
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        # large star: larger neighbours go to the smallest neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(_sent(least, 2 * mark["n"]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_sent(least, mark["n"]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = common.materialize(small.where("u <> v").distinct(), "edges", True)


def extend(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further ``links`` (a, b): only links between components take part in the new steps."""
    known = _sent(roots, roots.count())
    a, b = (known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    named = links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    named = common.materialize(named, "named", True)
    merged = components(named.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    merged = _sent(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), merged.count())
    fresh = named.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.node", "x.root")
    every = roots.select("node", "root").union(fresh).distinct()
    return common.materialize(every.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", True)
