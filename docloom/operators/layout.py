"""From words on pages to section fragments.

Everything is a window or an aggregate inside a document: ``doc_id`` leads every partitioning, so documents run in
parallel and no window spans the corpus. Columns: words(doc_id, page, word_id, text, x0, top, bottom, size, fontname),
lines(doc_id, page, col, line_no, text, size, bold, upper, y_top, y_bot), tables(doc_id, page, t_idx, y0, y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def column_histogram(words: DataFrame, width: float | Column = 612.0) -> DataFrame:
    """(doc_id, page, bucket, n): words by where they begin, with empty buckets."""
    share = F.lit(width) / C.COLUMN_BUCKETS if not isinstance(width, Column) else width / C.COLUMN_BUCKETS
    bucket = F.least(F.floor(F.col("x0") / share).cast("int"), F.lit(C.COLUMN_BUCKETS - 1))
    at = words.withColumn("__b", bucket)
    counts = at.groupBy("doc_id", "page").agg(*[F.count_if(F.col("__b") == b).alias(str(b)) for b in range(C.COLUMN_BUCKETS)])
    return counts.select("doc_id", "page", F.posexplode(F.array(*[F.col(str(b)) for b in range(C.COLUMN_BUCKETS)])).alias("bucket", "n"))


def detect_columns(words: DataFrame, width: float | Column = 612.0) -> DataFrame:
    """(doc_id, page, n_cols): 2 where an almost empty strip has dense ones on both sides, and there are enough words."""
    order = Window.partitionBy("doc_id", "page").orderBy("bucket")
    left, right = F.sum("n").over(order.rowsBetween(-C.COLUMN_REACH, -1)), F.sum("n").over(order.rowsBetween(1, C.COLUMN_REACH))
    inner = F.col("bucket").between(C.COLUMN_MARGIN, C.COLUMN_BUCKETS - C.COLUMN_MARGIN - 1)
    gutter = inner & (F.col("n") <= 1) & (left >= C.COLUMN_DENSITY) & (right >= C.COLUMN_DENSITY)
    strips = column_histogram(words, width).withColumn("gutter", F.coalesce(gutter, F.lit(False)))
    two = F.bool_or("gutter") & (F.sum("n") >= C.COLUMN_MIN_WORDS)
    return strips.groupBy("doc_id", "page").agg(F.when(two, 2).otherwise(1).alias("n_cols"))


def split_columns(words: DataFrame, width: float | Column = 612.0) -> DataFrame:
    """Words with ``col``: 1 for those that begin in the right half of a page of two columns."""
    middle = F.lit(width) / 2 if not isinstance(width, Column) else width / 2
    return words.join(detect_columns(words, width), ["doc_id", "page"]).withColumn("col", ((F.col("n_cols") == 2) & (F.col("x0") >= middle)).cast("int")).drop("n_cols")


def assemble_lines(words: DataFrame) -> DataFrame:
    """Lines of words with ``col``: a new one where ``top`` moves by more than the gap from the word before."""
    place = Window.partitionBy("doc_id", "page", "col").orderBy("__row", "x0", "word_id")
    jump = F.abs(F.col("top") - F.lag("top").over(place)) > C.LINE_GAP
    rows = words.withColumn("__row", F.bround(F.col("top") / C.LINE_QUANTUM) * C.LINE_QUANTUM)
    rows = rows.withColumn("__jump", F.coalesce(jump, F.lit(False)).cast("int")).withColumn("__line", F.sum("__jump").over(place)).withColumn("__at", F.row_number().over(place))
    lines = rows.groupBy("doc_id", "page", "col", "__line").agg(
        T.strip(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("__at", "text"))), lambda w: w["text"]))).alias("text"),
        F.avg(F.coalesce("size", F.lit(0.0))).alias("size"),
        F.bool_or(F.coalesce(F.lower("fontname").contains("bold"), F.lit(False))).alias("bold"),
        F.min("top").alias("y_top"),
        F.max("bottom").alias("y_bot"),
    )
    kept = lines.where(F.length("text") > 0)
    number = F.row_number().over(Window.partitionBy("doc_id", "page", "col").orderBy("__line")) - 1
    return kept.withColumn("line_no", number).withColumn("upper", is_upper(F.col("text"))).drop("__line")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & text.rlike(r"\p{L}")


def modal_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, page, col, body_size): the most frequent size to one decimal; of equals the one seen first."""
    sized = lines.withColumn("__s", F.round("size", 1))
    counts = sized.where("__s > 0").groupBy("doc_id", "page", "col", "__s").agg(F.count("*").alias("n"), F.min("line_no").alias("seen"))
    best = counts.groupBy("doc_id", "page", "col").agg(F.max_by("__s", F.struct("n", -F.col("seen"))).alias("body_size"))
    pages = lines.select("doc_id", "page", "col").distinct()
    return pages.join(best, ["doc_id", "page", "col"], "left").withColumn("body_size", F.coalesce("body_size", F.lit(C.DEFAULT_SIZE)))


def heading_level(size: Column, bold: Column, upper: Column, text: Column, body: Column) -> Column:
    """1, 2, 3 or null for body text."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    plain = (F.length(bare) <= 2) | bare.rlike(r"^\p{Nd}+$")
    return (
        F.when(plain, F.lit(None).cast("int"))
        .when((size >= body + 4.0) | ((size >= body + 2.0) & bold), 1)
        .when((size >= body + 1.5) & (bold | upper), 2)
        .when(bold & upper & (size >= body - 0.5), 3)
    )


def with_levels(lines: DataFrame) -> DataFrame:
    sized = lines.join(modal_sizes(lines), ["doc_id", "page", "col"])
    return sized.withColumn("level", heading_level(*(F.col(c) for c in ("size", "bold", "upper", "text", "body_size"))))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose middle lies in no table of their page: an equi-join with a residual range, as an anti join."""
    t = tables.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "y0", "y1")
    middle = (F.col("y_top") + F.col("y_bot")) / 2
    return lines.join(t, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & middle.between(F.col("y0"), F.col("y1")), "left_anti")


def captions(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Tables with ``caption``: the last three lines whose middle lies in the band above."""
    t = tables.select("doc_id", "page", "t_idx", "y0")
    middle = (F.col("y_top") + F.col("y_bot")) / 2
    top = F.greatest(F.lit(0.0), F.col("y0") - C.CAPTION_BAND)
    near = t.join(lines.select("doc_id", "page", "col", "line_no", "text", "y_top", "y_bot"), ["doc_id", "page"]).where((F.col("y0") - top >= 2) & (middle >= top) & (middle <= F.col("y0")) & (F.length(T.strip(F.col("text"))) > 0))
    last = F.row_number().over(Window.partitionBy("doc_id", "page", "t_idx").orderBy(F.desc("y_top"), F.desc("col"), F.desc("line_no")))
    near = near.withColumn("__r", last).where(F.col("__r") <= C.CAPTION_LINES)
    said = near.groupBy("doc_id", "page", "t_idx").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("o"), T.strip(F.col("text")).alias("t")))), lambda x: x["t"])).alias("caption"))
    return tables.join(said, ["doc_id", "page", "t_idx"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def titles(documents: DataFrame, lines: DataFrame, height: float | Column = 792.0) -> DataFrame:
    """(doc_id, title): of the metadata if longer than four characters, else the largest line of the top of page 1, else of page 1."""
    limit = height * 0.4 if isinstance(height, Column) else F.lit(height * 0.4)
    first = lines.where("page = 1")
    key = F.struct("size", (-F.col("col")).alias("c"), (-F.col("line_no")).alias("l"))
    best = first.groupBy("doc_id").agg(F.max_by(F.when(F.col("y_top") < limit, F.col("text")), F.when(F.col("y_top") < limit, key)).alias("__top"), F.max_by("text", key).alias("__any"))
    meta = F.when(F.length("meta_title") > 4, F.col("meta_title"))
    return documents.select("doc_id", "meta_title").join(best, "doc_id", "left").select("doc_id", F.coalesce(meta, "__top", "__any", F.lit("")).alias("title"))


def guard_references(lines: DataFrame) -> DataFrame:
    """Body lines after a heading of references go; headings stay. ``lines`` have ``level`` and ``seq``."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("level").isNotNull() & T.is_reference_heading(F.col("text"))
    return lines.withColumn("__ref", F.max(hit.cast("int")).over(order)).where(F.col("level").isNotNull() | (F.col("__ref") == 0)).drop("__ref")


def with_sequence(lines: DataFrame) -> DataFrame:
    return lines.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "col", "line_no")))


def fragments(lines: DataFrame) -> DataFrame:
    """(doc_id, page, frag_seq, heading, level, sentences) of lines with ``level`` and ``seq``.

    A heading opens a group, which goes on over pages; body text is joined for each group and page.
    """
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("level").isNotNull()
    named = lines.withColumn("frag_seq", F.sum(is_head.cast("int")).over(order)).withColumn("heading", F.coalesce(F.last(F.when(is_head, F.col("text")), True).over(order), F.lit(""))).withColumn("__level", F.coalesce(F.last("level", True).over(order), F.lit(1)))
    body = named.where(~is_head).groupBy("doc_id", "page", "frag_seq", "heading", F.col("__level").alias("level"))
    joined = body.agg(T.clean_text(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]))).alias("text"))
    # a text that is not empty has a sentence; a filter on the sentences would split every text once more
    return joined.where(F.length("text") > 0).withColumn("sentences", T.sentences(F.col("text"))).drop("text")


def extract(words: DataFrame, tables: DataFrame, width: float | Column = 612.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, fragments, tables with captions) of words."""
    lines = assemble_lines(split_columns(words, width))
    kept = with_sequence(outside_tables(with_levels(lines), tables))
    return lines, fragments(guard_references(kept)), captions(tables, lines)
