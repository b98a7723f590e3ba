"""Document fingerprints: MinHash signatures over word shingles, compared, and joined by bands.

``fingerprints`` deals documents out by ranges of ``doc_id`` and streams each range once, so that every text meets the
next one; the first text of a range also goes to the range before it. ``near_roots`` joins signature bands in Spark and
verifies Jaccard similarity on full sets. ``op5_fingerprints`` returns both.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups, similar

WIDTH = 5
PERCENT = 80
BANDS = 16
#: Least share of equal sketch bytes for a pair to be verified; one of similarity 0.8 falls short (five deviations of 64) about once in 10^6.
SKETCH = 0.55
SCHEMA = "node long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LIMIT = 3 << 20


def fingerprint(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """A row of 16-bit minima for each text; the row of a text without words has all bits set."""
    return (similar.signatures(*similar.shingles(texts, width)) & 0xFFFF).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima, an estimate of the Jaccard similarity; 1 for two texts without words."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: node (name of the shingle set, null if empty), doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next ``doc_id``, after the last the first; null ids come first, ties go by text.
    A null text is empty. A single document is its own next. An empty table gives no rows.
    """
    rows, _ = common.in_order(common.id_text(docs), ahead=True)

    def made(ids: list, texts: list[str]):
        """Rows for all but the last text, which is only looked ahead to."""
        edited = [edit(t, u) for t, u in zip(texts, texts[1:], strict=False)]
        hashes, begin = similar.shingles(pa.array(texts, pa.string()), width)
        own, changed = (similar.signatures(hashes, begin) & 0xFFFF).astype("<u2"), fingerprint(pa.array(edited, pa.string()), width)
        return pa.RecordBatch.from_arrays([
            pa.array([similar.set_key(x) for x in similar.sets(hashes, begin[:-1])], pa.int64()),
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()), pa.array([x.tobytes().hex() for x in changed], pa.string()),
            pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:])),
        ], names=["node", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids: list = []
        texts: list[str] = []
        held, over = 0, False
        for batch in common.text_slices(batches, limit=_LIMIT):
            for i, t, ahead in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if over:
                    break
                if texts and (ahead or held > _LIMIT):
                    yield made(ids, [*texts, t])
                    ids, texts, held = [], [], 0
                over = ahead
                ids.append(i)
                texts.append(t)
                held += len(t)

    return rows.sortWithinPartitions("ahead", "doc_id", "text").mapInArrow(common.tidy(run), SCHEMA)


def _classes(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """(node, rep, many, fine, keys): the distinct shingle sets, how many documents have them, their sketch and the names of their bands."""
    common.ready(docs.sparkSession)
    assert similar.PERMUTATIONS // bands % 2 == 0

    def sign(batches):
        common.forget()
        for batch in common.text_slices(batches, limit=2 * similar.STRETCH):
            hashes, begin = similar.shingles(batch.column(1), width)
            sig = similar.signatures(hashes, begin)
            salt = np.arange(bands, dtype=np.uint64) << np.uint64(48)
            keys = similar.mix(similar.mix(sig.view(np.uint64)).reshape(len(sig), bands, -1).sum(axis=2, dtype=np.uint64) + salt)  # of the band and its minima
            names = [similar.set_key(x) for x in similar.sets(hashes, begin)]
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()), keys], names=["doc_id", "node", "fine", "keys"])

    signed = common.id_text(docs).mapInArrow(common.tidy(sign), "doc_id long, node long, fine binary, keys array<long>").where("node is not null and doc_id is not null")
    return common.materialize(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), F.first("fine").alias("fine"), F.first("keys").alias("keys")), "classes")


def _roots(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    level = classes.select(F.explode("keys").alias("path"), "node").distinct()
    return groups.roots_of(level, classes, docs, width, percent, SKETCH)


def near_roots(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """(node, root): distinct shingle sets by name with the smallest of their component, for all that are linked to another.

    Sets that meet in a band are compared without emitting the pairs of a bucket (see ``groups``), and links verified on
    full sets. A pair of similarity 0.8 meets in none of 16 bands of four minima with probability 2e-4, one of 0.9 with
    7e-8. Copies share a set; texts without words, and rows without id, are linked with nothing.
    """
    return _roots(_classes(docs, width, bands), docs, width, percent)


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Per row: the columns of ``fingerprints`` without node, component_id (the smallest id of the component), n_alike (rows in it).

    A row without words or id is a component of its own, but for a row without id whose set others have. Only classes that
    are not alone meet the fingerprints, so that these wide rows need no shuffle while there are few.
    """
    classes = _classes(docs, width, bands)
    roots = _roots(classes, docs, width, percent)
    named = classes.select("node", "rep", "many").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("many").alias("n_alike"))
    found = common.materialize(named.join(sums.where("n_alike > 1"), "root").select("node", "component_id", "n_alike"), "found", True)
    if found.count() <= similar.BROADCAST_IDS:
        found = F.broadcast(found)
    out = fingerprints(docs, width).join(found, "node", "left")
    return out.drop("node").withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("n_alike", F.coalesce("n_alike", F.lit(1)))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir))
