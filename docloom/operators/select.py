"""Maximal marginal relevance over the candidates of each query.

The greedy choice is sequential within a query and its input bounded by the neighbourhood of a few chunks, so each
query is one Arrow group; queries run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import vectors as V

SELECTED = "doc_id long, query_id long, mmr_rank int, node_id string, query_sim double, mmr_score double"


def mmr_candidates(results: DataFrame, neighbours: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, query_id, node_id, is_top_k, seq, query_sim, normalized_score, embedding).

    ``results`` (doc_id, query_id, rank, node_id, normalized_score) come first, then new neighbours by id; ``nodes`` have
    (doc_id, node_id, embedding), ``queries`` (doc_id, query_id, embedding). A neighbour's score is its place in the range of
    the results' similarities, times 0.9, within 0 and 1.
    """
    top = results.select("doc_id", "query_id", "node_id", F.lit(True).alias("is_top_k"), F.col("rank").cast("int").alias("rank"), "normalized_score")
    new = neighbours.select("doc_id", "query_id", F.col("neighbour_id").alias("node_id")).distinct().join(top.select("doc_id", "query_id", "node_id"), ["doc_id", "query_id", "node_id"], "left_anti")
    every = top.union(new.select("doc_id", "query_id", "node_id", F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("double")))
    rows = every.join(nodes.where("embedding is not null").select("doc_id", "node_id", "embedding"), ["doc_id", "node_id"]).join(queries.select("doc_id", "query_id", F.col("embedding").alias("__q")), ["doc_id", "query_id"])
    rows = rows.withColumn("query_sim", F.round(V.cosine(F.col("__q"), F.col("embedding")), 9)).drop("__q")
    part = Window.partitionBy("doc_id", "query_id")
    own = F.when(F.col("is_top_k"), F.col("query_sim"))
    low, span = F.min(own).over(part), F.max(own).over(part) - F.min(own).over(part)
    place = F.greatest(F.lit(0.0), F.least((F.col("query_sim") - low) / F.when(span > 0, span).otherwise(1.0) * 0.9, F.lit(1.0)))
    rows = rows.withColumn("normalized_score", F.coalesce("normalized_score", F.round(place, 4)))
    order = part.orderBy(F.desc("is_top_k"), F.asc_nulls_last("rank"), "node_id")
    return rows.withColumn("seq", F.row_number().over(order)).drop("rank")


def greedy(sims: np.ndarray, vectors: np.ndarray, weight: float, budget: int) -> list[tuple[int, float]]:
    """Places in order of choice, with their scores; of equals the first."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(size > 0, size, 1)
    most = np.full(len(sims), -np.inf)
    open_ = np.ones(len(sims), bool)
    out: list[tuple[int, float]] = []
    for _ in range(min(budget, len(sims))):
        score = weight * sims - ((1 - weight) * most if out else 0)
        at = int(np.argmax(np.where(open_, np.round(score, 9), -np.inf)))
        out.append((at, float(score[at])))
        open_[at] = False
        most = np.maximum(most, unit @ unit[at])
    return out


def mmr_select(candidates: DataFrame, weight: float = C.MMR_LAMBDA, budget: int = C.MMR_BUDGET) -> DataFrame:
    """(doc_id, query_id, mmr_rank, node_id, query_sim, mmr_score) of candidates with (seq, query_sim, embedding)."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        picked = greedy(rows["query_sim"].to_numpy(float), np.array(rows["embedding"].tolist(), np.float64), weight, budget)
        at = [i for i, _ in picked]
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[at].to_numpy(), "query_id": rows["query_id"].iloc[at].to_numpy(), "mmr_rank": range(1, len(at) + 1), "node_id": rows["node_id"].iloc[at].to_numpy(), "query_sim": rows["query_sim"].iloc[at].to_numpy(), "mmr_score": [s for _, s in picked]})

    return candidates.select("doc_id", "query_id", "seq", "node_id", "query_sim", "embedding").groupBy("doc_id", "query_id").applyInPandas(choose, SELECTED)
