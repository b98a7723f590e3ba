"""Context, prompt and answer for the chosen chunks of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import plugins
from ..functions import text as T


def chunk_line(text: Column, page: Column) -> Column:
    """The text, cut at 800 characters, and its page."""
    text = T.strip(F.coalesce(text, F.lit("")))
    short = F.when(F.length(text) > C.CONTEXT_CHARS, F.concat(F.substring(text, 1, C.CONTEXT_CHARS), F.lit("..."))).otherwise(text)
    return T.strip(F.concat_ws(" ", short, F.concat(F.lit("(p."), page.cast("string"), F.lit(")"))))


def assemble_context(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, context) of (keys, mmr_rank, section, text, page): chunks by section, sections as they first appear."""
    section = T.strip(F.coalesce("section", F.lit("")))
    rows = chosen.select(*keys, "mmr_rank", F.when(F.length(section) > 0, section).otherwise(F.lit("General")).alias("__s"), chunk_line(F.col("text"), F.col("page")).alias("__l"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("mmr_rank", "__l"))), lambda x: x["__l"])
    groups = rows.groupBy(*keys, "__s").agg(F.min("mmr_rank").alias("__o"), F.concat_ws("\n", F.concat(F.lit("["), F.first("__s"), F.lit("]")), lines).alias("__b"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("__o", "__b"))), lambda x: x["__b"])
    return groups.groupBy(*keys).agg(T.strip(F.concat_ws("\n\n", blocks)).alias("context"))


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the passages alone. State facts plainly, one a sentence.\n\nPassages:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def answers(chosen: DataFrame, queries: DataFrame, backend: str = "extractive") -> DataFrame:
    """(doc_id, query_id, query, prompt, answer); a query without chosen chunks is told so. Unknown backends raise ``ValueError``.

    A query without text goes by the beginning of its best chunk.
    """
    make = plugins.generator(backend)
    context = assemble_context(chosen, ["doc_id", "query_id"])
    texts = chosen.groupBy("doc_id", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mmr_rank", "text"))), lambda x: x["text"]).alias("__t"))
    rows = queries.select("doc_id", "query_id", "text").join(context, ["doc_id", "query_id"], "left").join(texts, ["doc_id", "query_id"], "left")
    rows = rows.withColumn("query", query_label(F.col("text"), F.get("__t", 0))).withColumn("prompt", prompt(F.coalesce("query", F.lit("")), F.coalesce("context", F.lit(""))))
    answer = F.when(F.col("__t").isNull(), F.lit("No relevant passages were found.")).otherwise(make(F.col("prompt"), F.col("__t")))
    return rows.select("doc_id", "query_id", "query", "prompt", answer.alias("answer"))


def query_label(text: Column, top_chunk: Column) -> Column:
    """The query, or the first 120 characters of the best chunk."""
    return F.coalesce(F.when(F.length(text) > 0, text), F.substring(top_chunk, 1, 120))


def split_claims(answers: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, claim_no, claim) from 1."""
    return answers.select(*keys, F.posexplode(T.claims(F.col(text))).alias("__p", "claim")).select(*keys, (F.col("__p") + 1).alias("claim_no"), "claim")
