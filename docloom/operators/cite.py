"""Citations for the claims of answers.

Candidates by cosine, their score by a scorer and shared keywords, and then, claim by claim within an answer, the best
candidate under a penalty for nodes that the answer has cited before. The last step carries state through the claims
of one answer, a few dozen rows; a task takes many answers, one after the other, from sorted rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import constants as C
from ..functions import text as T
from ..functions import vectors as V
from ..plugins import Embedder, Scorer, hash_embedder, overlap_scorer, prepared
from ..storage import materialize
from .retrieve import dense_rank, dense_topk

CITED = "claim_no int, claim string, cited boolean, score double, ce_score double, keyword_sim double, idx long"
#: The columns that name an answer.
ANSWER = ("answer_id",)


def score_candidates(claims: DataFrame, index: DataFrame, embed: Embedder = hash_embedder, scorer: Scorer = overlap_scorer, most: int = C.CITE_CANDIDATES, scope: list[str] | None = None, keys=ANSWER) -> DataFrame:
    """(keys, claim_no, claim, cand_no, idx, ce_score, keyword_sim, combined) of claims and index (idx, text, embedding).

    With ``scope``, columns of both and among ``keys``, a claim meets the entries of its own scope by a join; else it is
    held against the whole index in blocks. Keywords, and what the scorer needs of a text, are taken once from each claim
    and each entry, not from each pair.
    """
    scope, keys = scope or [], list(keys)
    prepare, compare = prepared(scorer)
    own = [] if prepare is T.keyword_ids else [prepare]  # a scorer by the same keywords reads the same columns
    cp, ep = ("__cp", "__ep") if own else ("__ck", "__ek")
    ask = claims.select(*keys, "claim_no", "claim", embed(F.col("claim")).alias("embedding"), T.keyword_ids(F.col("claim")).alias("__ck"), *[f(F.col("claim")).alias(cp) for f in own])
    ask = materialize(ask.withColumn("query_id", F.monotonically_increasing_id()), "claims")
    vectors = ask.select(*scope, "query_id", "embedding")
    best = dense_rank(vectors, index, scope).where(F.col("rank") <= most) if scope else dense_topk(vectors, index, most)
    best = materialize(best.select(*scope, "query_id", "idx", F.col("rank").alias("cand_no")), "best")
    read = index.join(best.select(*scope, "idx").distinct(), [*scope, "idx"], "left_semi").select(*scope, "idx", T.keyword_ids(F.col("text")).alias("__ek"), *[f(F.col("text")).alias(ep) for f in own])
    rows = best.join(ask.drop("embedding"), [*scope, "query_id"]).join(materialize(read, "read"), [*scope, "idx"])
    rows = rows.withColumn("ce_score", V.sigmoid(compare(F.col(cp), F.col(ep)))).withColumn("keyword_sim", T.keyword_jaccard(F.col("__ck"), F.col("__ek")))
    return rows.select(*keys, "claim_no", "claim", "cand_no", "idx", "ce_score", "keyword_sim", F.round(F.col("ce_score") + F.col("keyword_sim") * C.KEYWORD_WEIGHT, 9).alias("combined"))


def _codes(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A row of numbers for each row, equal where the keys are."""
    return np.stack([pd.factorize(rows[k], use_na_sentinel=False)[0] for k in keys], axis=1)


def choose(rows: pd.DataFrame, threshold: float, alpha: float, limit: int, keys: list[str]) -> pd.DataFrame:
    """One row for each claim: its best candidate, cited if it reaches ``threshold``; rows by answer, claim and candidate."""
    number = rows["claim_no"].to_numpy()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (np.diff(_codes(rows, keys), axis=0) != 0).any(axis=1)
    starts = np.flatnonzero(fresh | (np.diff(number, prepend=number[:1]) != 0)).tolist()
    fresh = fresh.tolist()
    idx, combined, ce, keyword = (rows[c].tolist() for c in ("idx", "combined", "ce_score", "keyword_sim"))
    cited: dict[int, int] = {}
    out = []
    for a, b in zip(starts, [*starts[1:], len(idx)], strict=True):
        if fresh[a]:
            cited = {}
        scores = [-1.0 if (times := cited.get(i, 0)) >= limit else c / (1 + alpha * times) for i, c in zip(idx[a:b], combined[a:b], strict=True)]
        top = max(scores)
        best = a + scores.index(top)  # of equals the first
        ok = top >= threshold
        if ok:
            cited[idx[best]] = cited.get(idx[best], 0) + 1
        out.append((ok, round(top, 4), round(ce[best], 4), round(keyword[best], 4), idx[best] if ok else None))
    made = pd.DataFrame(out, columns=[c.split()[0] for c in CITED.split(", ")][2:])
    named = rows[[*keys, "claim_no", "claim"]].iloc[starts].reset_index(drop=True)
    return pd.concat([named, made.astype({"idx": "Int64"})], axis=1)


def cite(candidates: DataFrame, threshold: float = C.CITE_THRESHOLD, alpha: float = C.DIVERSITY_ALPHA, limit: int = C.HUB_LIMIT, keys=ANSWER) -> DataFrame:
    """(keys, claim_no, claim, cited, score, ce_score, keyword_sim, idx)."""
    keys = list(keys)
    schema = S.StructType([candidates.schema[k] for k in keys] + S.StructType.fromDDL(CITED).fields)

    def run(frames):
        """Whole answers of a sorted partition; the last one of a batch goes on in the next."""
        rest = None
        for rows in frames:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if rows.empty:
                continue
            codes = _codes(rows, keys)
            last = max(np.flatnonzero((codes != codes[-1]).any(axis=1)), default=-1) + 1
            if last:
                yield choose(rows.iloc[:last], threshold, alpha, limit, keys)
            rest = rows.iloc[last:]
        if rest is not None and len(rest):
            yield choose(rest, threshold, alpha, limit, keys)

    return candidates.repartition(*keys).sortWithinPartitions(*keys, "claim_no", "cand_no").mapInPandas(run, schema)


def citation(page: Column, node_id: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("[p. "), page.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[node:"), node_id, F.lit("]")))


def with_provenance(cited: DataFrame, index: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Claims with matched node, text, page, section and the text with its citation; ``index`` has (idx, node_id, text, page, section)."""
    rows = cited.join(index.select(*(scope or []), "idx", F.col("node_id").alias("matched_node"), F.col("text").alias("matched_text"), "page", "section"), [*(scope or []), "idx"], "left")
    sign = F.when(F.col("cited"), citation(F.col("page"), F.col("matched_node")))
    return rows.withColumn("citation", sign).withColumn("cited_text", F.concat_ws(" ", "claim", "citation")).drop("idx")


def cite_claims(claims: DataFrame, index: DataFrame, embed: Embedder = hash_embedder, scorer: Scorer = overlap_scorer, threshold: float = C.CITE_THRESHOLD, alpha: float = C.DIVERSITY_ALPHA, limit: int = C.HUB_LIMIT, scope: list[str] | None = None, keys=ANSWER) -> DataFrame:
    """Every claim of (keys, claim_no, claim) with its citation or without; an empty index leaves all uncited, with null scores."""
    found = cite(score_candidates(claims, index, embed, scorer, scope=scope, keys=keys), threshold, alpha, limit, keys).drop("claim")
    rows = claims.join(found, [*keys, "claim_no"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return with_provenance(rows, index, scope)


def citation_stats(cited: DataFrame, *keys: str) -> DataFrame:
    """Totals and means, by ``keys`` or over all."""
    total = F.count("*")
    return cited.groupBy(*keys).agg(
        total.alias("total_claims"), F.count_if("cited").alias("n_cited"), F.count_if(~F.col("cited")).alias("uncited"),
        F.round(F.coalesce(F.try_divide(F.count_if("cited").cast("double"), total.cast("double")), F.lit(0.0)), 4).alias("cite_rate"),
        F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.min("score"), 4).alias("min_score"), F.round(F.max("score"), 4).alias("max_score"),
        F.round(F.avg("ce_score"), 4).alias("mean_ce_score"), F.round(F.avg("keyword_sim"), 4).alias("mean_keyword_sim"),
    )


def sources(cited: DataFrame, keys=ANSWER) -> DataFrame:
    """(keys, answer, source_pages): cited texts joined, and the sorted distinct pages."""
    return cited.groupBy(*keys).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "cited_text"))), lambda x: x["cited_text"])).alias("answer"), F.array_sort(F.collect_set("page")).alias("source_pages"))
