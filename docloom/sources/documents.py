"""Sources: files through a parser plug-in, lines of text documents, web pages, and a literal document."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import is_upper
from ..plugins import html_lines
from ..storage import materialize

#: A small fixed document of our own: title, and by page one section with its sentences and one table.
DEMO_TITLE = "Notes on Garden Bridges"
DEMO = (
    (1, "Planks and Beams", 1,
     ("Oak planks of forty millimetres carry two walkers at once.", "Larch beams last longest when their ends stay dry."),
     "Table 1 - Spans by beam depth",
     (("Beam", "Depth (cm)", "Span (m)", "Weight (kg)", "Timber", "Planks"), ("A", "10", "1.5", "22", "Larch", "9"),
      ("B", "14", "2.4", "41", "Larch", "14"), ("C", "18", "3.2", "66", "Oak", "19"))),
    (2, "Paint and Weather", 1,
     ("Linseed paint resists rain and frost for about seven winters.", "Zinc screws and brass hinges keep their grip in wet weather."),
     "Table 2 - Winters until repainting",
     (("Finish", "Coats", "Winters", "Drying (h)", "Use"), ("Linseed paint", "3", "7", "48", "Rails"),
      ("Tar", "2", "9", "72", "Posts"), ("Wax", "4", "2", "12", "Seats"))),
)


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def normalize_path(raw: str) -> str:
    """Trimmed, without quotes around, the home folder written out."""
    return os.path.expanduser(raw.strip().strip("'\"").strip())


def scan_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, stem, content_hash, length, content) of files under ``path``, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(normalize_path(path))
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), content_hash(F.col("content")).alias("content_hash"), "length", "content")


def parse_files(files: DataFrame, parser: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows of ``parser(path, bytes)`` over files, and (path, error) of those it cannot read.

    Both come from one written pass, so a file is read once and none goes without a trace.
    """

    def run(batches):
        import pandas as pd

        names = [c.strip().split()[0] for c in schema.split(",")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.extend((*row, path, None) for row in parser(path, bytes(content)))
                except (ValueError, OSError, KeyError) as e:
                    rows.append((*[None] * len(names), path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*names, "__path", "__error"], dtype=object)

    found = materialize(files.select("path", "content").mapInPandas(run, f"{schema}, __path string, __error string"), "parsed")
    return found.where("__error is null").drop("__path", "__error"), found.where("__error is not null").select(F.col("__path").alias("path"), F.col("__error").alias("error"))


def text_lines(documents: DataFrame, lines_a_page: int = 40, line_height: float = 14.0) -> DataFrame:
    """Plain text (doc_id, text) as lines on pages; size and weight stand for a layout, from the length of each line."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("__n", "text"))
    n = F.length("text")
    top = (F.col("__n") % lines_a_page) * line_height
    return rows.select(
        "doc_id", (F.floor(F.col("__n") / lines_a_page) + 1).cast("int").alias("page"), F.lit(0).alias("col"), F.col("__n").alias("line_no"), "text",
        F.when(n % 11 == 0, 16.0).when(n % 7 == 0, 12.0).otherwise(10.0).alias("size"), (n % 2 == 0).alias("bold"), is_upper(F.col("text")).alias("upper"),
        top.alias("y_top"), (top + 10).alias("y_bot"),
    )


def web_lines(pages: DataFrame) -> DataFrame:
    return html_lines(pages)


def raw_tables(tables: DataFrame) -> DataFrame:
    """Tables of two rows or more."""
    return tables.where(F.size("raw") >= 2)


def queries(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(query_id, text) of the filled ones."""
    return spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts) if t.strip()], "query_id long, text string")


def demo_fragments(spark: SparkSession, doc_id: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, fragments, tables) of the literal document."""
    documents = spark.createDataFrame([(doc_id, "demo", DEMO_TITLE)], "doc_id long, stem string, title string")
    fragments = spark.createDataFrame([(doc_id, page, 1, head, level, list(sents)) for page, head, level, sents, _, _ in DEMO], "doc_id long, page int, frag_seq long, heading string, level int, sentences array<string>")
    tables = spark.createDataFrame([(doc_id, page, 0, [list(r) for r in raw], said) for page, _, _, _, said, raw in DEMO], "doc_id long, page int, t_idx int, raw array<array<string>>, caption string")
    return documents, fragments, tables
