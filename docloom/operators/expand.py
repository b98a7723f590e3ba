"""Neighbourhoods of chunks: window, siblings and cousins, as joins inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import vectors as V


def boundary_sentences(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, first_sentence, last_sentence): where a chunk begins and ends."""
    return chunks.select("doc_id", "chunk_id", F.concat(F.lit("sentence::"), "first_idx").alias("first_sentence"), F.concat(F.lit("sentence::"), "last_idx").alias("last_sentence"))


def siblings(origins: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, query_id, origin_id, neighbour_id): other chunks of the origin's section."""
    home = chunks.select("doc_id", F.col("chunk_id").alias("origin_id"), "section_no")
    other = chunks.select("doc_id", "section_no", F.col("chunk_id").alias("neighbour_id"))
    return origins.select("doc_id", "query_id", "origin_id").join(home, ["doc_id", "origin_id"]).join(other, ["doc_id", "section_no"]).where("origin_id <> neighbour_id").select("doc_id", "query_id", "origin_id", "neighbour_id")


def cousins(origins: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks of the other subsections of the parent of the origin's section."""
    home = chunks.select("doc_id", F.col("chunk_id").alias("origin_id"), F.col("section_no").alias("own"))
    parent = sections.where("parent_no is not null").select("doc_id", F.col("section_no").alias("own"), "parent_no")
    sub = sections.where("parent_no is not null").select("doc_id", "parent_no", "section_no")
    other = chunks.select("doc_id", "section_no", F.col("chunk_id").alias("neighbour_id"))
    rows = origins.select("doc_id", "query_id", "origin_id").join(home, ["doc_id", "origin_id"]).join(parent, ["doc_id", "own"]).join(sub, ["doc_id", "parent_no"]).where("own <> section_no")
    return rows.join(other, ["doc_id", "section_no"]).select("doc_id", "query_id", "origin_id", "neighbour_id")


def window(origins: DataFrame, chunks: DataFrame, least: float = C.WINDOW_SIMILARITY) -> DataFrame:
    """Chunks before and after the origin in its section, up to the first that is too unlike the origin.

    Sentences are linked inside a section only, so the walk over sentences is one over the section's chunks in order:
    a running minimum of "alike enough" on each side.
    """
    home = chunks.select("doc_id", F.col("chunk_id").alias("origin_id"), "section_no", F.col("chunk_no").alias("__at"), F.col("embedding").alias("__o"))
    other = chunks.select("doc_id", "section_no", "chunk_no", F.col("chunk_id").alias("neighbour_id"), F.col("embedding").alias("__e"))
    rows = origins.select("doc_id", "query_id", "origin_id").join(home, ["doc_id", "origin_id"]).join(other, ["doc_id", "section_no"]).where("chunk_no <> __at")
    rows = rows.withColumn("__far", F.abs(F.col("chunk_no") - F.col("__at"))).withColumn("__side", F.col("chunk_no") > F.col("__at"))
    near = F.coalesce(F.round(V.cosine(F.col("__o"), F.col("__e")), 9) >= least, F.lit(False)).cast("int")
    walk = Window.partitionBy("doc_id", "query_id", "origin_id", "__side").orderBy("__far").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__ok", F.min(near).over(walk)).where("__ok = 1").select("doc_id", "query_id", "origin_id", "neighbour_id")


def neighbourhood(origins: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Siblings and cousins; the window lies within the siblings, as links never leave a section."""
    return siblings(origins, chunks).union(cousins(origins, chunks, sections)).distinct()
