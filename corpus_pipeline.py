"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of a run may write each result and read it
again. All but the last return the columns of ``documents``. In every stage an empty table gives an empty one, long texts
are taken whole, ties do not matter, and columns besides ``doc_id``, ``text`` and ``lang`` pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common
from docloom.llm.op2_best_fit_packing import pack
from docloom.llm.op3_near_dedup import one_of_each
from docloom.llm.op6_secret_scan import redact
from docloom.llm.op10_quality_rules import kept_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go.

    Null, empty and blank texts go, as they have fewer words than the base rules ask for. Repeated rows stay or go together.
    """
    return kept_documents(docs, common.ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the smallest id stays.

    Null, empty and blank texts are like nothing and stay, as do rows without id. Rows that repeat an id stay or go together.
    """
    common.ready(spark)
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null and empty texts as they are, repeated rows each."""
    common.ready(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens; a null or empty text is one piece, repeated rows are packed each."""
    common.ready(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Packing needs a tokenizer, which SQL cannot express; tests hold the run against a brute-force version.
ORACLE_SQL = None
