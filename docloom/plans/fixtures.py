"""Inputs of every operator derived from the tables by plain expressions, so that SQL can state them as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, layout
from ..sources.documents import text_lines
from ..storage import spread

WIDTH = 612.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def hyphenated(docs: DataFrame) -> DataFrame:
    """Every tenth blank a hyphen and a line break."""
    return docs.select("doc_id", F.regexp_replace("text", r"((?:[^ ]* ){9}[^ ]*) ", "$1-\n").alias("text"))


def marked(docs: DataFrame) -> DataFrame:
    """Marker words at the end of some documents."""
    tail = F.concat(F.when(F.col("doc_id") % 9 == 0, " SHALL NOT restricted").otherwise(""), F.when(F.col("doc_id") % 13 == 0, " prohibited").otherwise(""))
    return docs.select("doc_id", F.concat("text", tail).alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    return text_lines(docs.select("doc_id", "text"))


def words(docs: DataFrame) -> DataFrame:
    """Words at places that make one column for even documents and two for odd ones."""
    rows = lines(docs).select("doc_id", "page", "line_no", "y_top", "y_bot", "size", "bold", F.posexplode(F.split("text", " ")).alias("pos", "text")).where("text <> ''")
    k = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no", "pos")) - 1
    rows = rows.withColumn("k", k)
    one = 40 + F.col("k") * 37 % 530
    two = F.when(F.col("k") % 2 == 0, 40).otherwise(340) + F.col("k") * 37 % 230
    return rows.select("doc_id", "page", F.col("k").alias("word_id"), "text", F.when(F.col("doc_id") % 2 == 0, one).otherwise(two).cast("double").alias("x0"), F.col("y_top").alias("top"), F.col("y_bot").alias("bottom"), "size", F.when(F.col("bold"), "Bold").otherwise("Regular").alias("fontname"))


def tables(docs: DataFrame) -> DataFrame:
    """A box on every page whose number and document add up to a multiple of five."""
    pages = lines(docs).select("doc_id", "page").distinct()
    return pages.where((F.col("doc_id") + F.col("page")) % 5 == 0).select("doc_id", "page", F.lit(0).alias("t_idx"), F.lit(140.0).alias("y0"), F.lit(196.0).alias("y1"))


def levelled(docs: DataFrame) -> DataFrame:
    """Lines with level (body size 10) and sequence; line 20 of every tenth document is a heading of references."""
    hit = (F.col("doc_id") % 10 == 0) & (F.col("line_no") == 20)
    rows = lines(docs).withColumn("text", F.when(hit, "References").otherwise(F.col("text"))).withColumn("size", F.when(hit, 16.0).otherwise(F.col("size")))
    level = layout.heading_level(F.col("size"), F.col("bold"), F.col("upper"), F.col("text"), F.lit(10.0))
    return layout.with_sequence(rows.withColumn("level", level))


def fragments(docs: DataFrame) -> DataFrame:
    return layout.fragments(layout.guard_references(levelled(docs)))


def merged(docs: DataFrame) -> DataFrame:
    return graph.merge_sections(fragments(docs))


def cut(docs: DataFrame) -> DataFrame:
    """Filled lines as sentences: eight to a chunk, twelve to a page."""
    rows = lines(docs).where(F.length("text") > 0)
    return rows.select("doc_id", F.col("line_no").alias("idx"), F.floor(F.col("line_no") / 8).cast("int").alias("chunk_no"), (F.floor(F.col("line_no") / 12) + 1).cast("int").alias("page"), "text")


def fragment_chunks(docs: DataFrame) -> DataFrame:
    """Each fragment as a chunk of its section."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "frag_seq"))
    return merged(docs).withColumn("chunk_no", number).withColumn("chunk_id", F.concat(F.lit("chunk::"), "chunk_no"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids divisible by 50, against all rows."""
    return vectors(spark, sf_dir).where("idx % 50 = 0").select(F.col("idx").alias("query_id"), "embedding", "label")
