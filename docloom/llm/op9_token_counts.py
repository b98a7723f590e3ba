"""Token counts: encoding inside Arrow functions that return lengths only.

Batches are cut by bytes, long texts at places where no token can cross (see ``common.cuts``); each distinct chunk of
a batch is encoded once and only its length is spread over the rows. Narrow plan: scan, one Python step, no shuffle.
A lost executor costs the re-run of its own input splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; blank texts have 0 tokens. Special strings inside a text count as
    the library's default has it. Repeated rows are counted each; an empty table gives no rows.
    """

    def count(batches):
        enc = common.encoder(common.vocabulary(vocabulary))
        for batch in common.text_slices(batches):
            _, offsets = common.raw(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(enc.lengths(batch.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    return common.id_text(docs).mapInArrow(count, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))
