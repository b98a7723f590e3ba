"""Queries of this subpackage and their SQL, by the names that ``__spark_entry__`` registers."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import op10_quality_rules as quality
from .op1_lm_scoring import op1_lm_scoring
from .op10_quality_rules import op10_quality_rules
from .op2_best_fit_packing import op2_best_fit_packing
from .op3_near_dedup import op3_near_dedup
from .op4_token_files import op4_token_files
from .op5_fingerprints import op5_fingerprints
from .op6_secret_scan import op6_secret_scan
from .op7_byte_bpe import op7_byte_bpe
from .op8_sharding import op8_feistel_sharding
from .op9_token_counts import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_token_files": op4_token_files,
    "op5_fingerprints": op5_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_feistel_sharding": op8_feistel_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op10_quality_rules": quality.ORACLE,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
