"""Rankings, fusion and page scores for batches of queries.

Scores of BM25 come from an equi-join of query terms with postings, so only entries that share a term are touched.
Dense scores multiply blocks of queries with blocks of the index inside Arrow batches and keep the best of each query, so
nothing but those leaves a task. Ties go to the smaller index, then to the earlier rank, as stated at each function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import vectors as V
from ..plugins import Scorer, as_matrix, overlap_scorer
from ..storage import materialize
from .index import Bm25

#: Bytes of query vectors up to which they are sent to every task; more meet the index in a grid of blocks.
QUERY_BYTES = 8 << 20
#: Bytes of vectors in a block, and similarities that a task holds at once.
BLOCK_BYTES, HELD = 8 << 20, 1 << 20
#: Blocks of the index that a task of the grid goes through, and the queries and entries that it multiplies at once.
PART_BLOCKS, TILE = 8, (256, 1024)
_DIGITS = 9


def query_terms(queries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(query_id, term, qtf)."""
    words = queries.select(*(scope or []), "query_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.groupBy(*(scope or []), "query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(terms: DataFrame, index: Bm25) -> DataFrame:
    """(scope, query_id, idx, score) of entries that share a term with the query; all others score 0."""
    s = index.scope
    known = terms.join(index.terms, [*[c for c in s if c in terms.columns], "term"])
    hits = known.join(index.postings, [*s, "term"]).join(index.docs, [*s, "idx"])
    hits = hits.join(index.corpus, s) if s else hits.join(F.broadcast(index.corpus), F.lit(True))
    tf = F.col("tf")
    weight = F.col("qtf") * F.col("idf") * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(*s, "query_id", "idx").agg(F.round(F.sum(weight), _DIGITS).alias("score"))


def floor_and_rank(scores: DataFrame, scope: list[str] | None = None, floor: float = C.BM25_FLOOR, most: int | None = None) -> DataFrame:
    """Scores of at least ``floor`` times the query's best, with ``rank`` from 1; ties by idx."""
    part = [*(scope or []), "query_id"]
    order = Window.partitionBy(*part).orderBy(F.desc("score"), "idx")
    best = F.max("score").over(Window.partitionBy(*part))
    out = scores.withColumn("__best", best).where(F.col("score") >= F.col("__best") * floor).drop("__best").withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= most) if most else out


def dense_topk(queries: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """(query_id, idx, sim, rank): the ``most`` entries nearest by cosine for each of (query_id, embedding); ties by idx.

    Up to ``QUERY_BYTES`` of query vectors are sent to all tasks, and the index stays where it is. Beyond that, both sides
    are packed into blocks, and each task of a grid holds some blocks of queries against ``PART_BLOCKS`` of the index. It
    multiplies in floats and takes up again in doubles what may be among the best so far, with a margin for the error of
    floats; what leaves it is the best of each query, one row for a block of queries.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("id"), "embedding").where("embedding is not null")
    entries = index.select(F.col("idx").cast("long").alias("id"), "embedding").where("embedding is not null")
    size = asked.agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n")).first()
    dim = size["dim"] or 0
    if 8 * dim * size["n"] <= QUERY_BYTES:
        rows = asked.toArrow().combine_chunks()
        ids = rows["id"].to_numpy()
        matrix = _unit(as_matrix(rows["embedding"])) if len(ids) else np.zeros((0, dim))
        sent = index.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches):
            for batch in batches:
                if batch.num_rows and len(sent.value[0]):
                    yield _nearest(*sent.value, batch.column(0).to_numpy(zero_copy_only=False), _unit(as_matrix(batch.column(1))), most)

        out = entries.mapInArrow(run, _NEAREST)
    else:
        return _grid(asked, entries, dim, most)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "idx")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


_NEAREST = "query_id long, idx long, sim double"


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True) if rows.size else np.ones((len(rows), 1))
    return rows / np.where(size > 0, size, 1)


def _packed(rows: DataFrame, dim: int, size: int, copies: int | None = None) -> DataFrame:
    """Blocks of (id, embedding) rows of ``size`` bytes: (block, ids, vectors), in the order of ids, the vectors of length one, as bytes.

    Of equal vectors in a block only the first ``copies`` stay, as no more of them can be among as many best.
    """
    many = max(1, size // (8 * dim))

    def pack(batches):
        block, ids, vectors, held = TaskContext.get().partitionId() << 33, [], [], 0

        def made():
            names, matrix = np.concatenate(ids), np.concatenate(vectors)
            order = np.argsort(names, kind="stable")
            names, matrix = names[order], np.ascontiguousarray(matrix[order])
            if copies:
                _, alike = np.unique(matrix.view(f"V{8 * dim}").ravel(), return_inverse=True)
                by = np.argsort(alike, kind="stable")
                first = np.arange(len(by)) - np.searchsorted(alike[by], alike[by]) < copies
                stay = np.sort(by[first])
                names, matrix = names[stay], matrix[stay]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([names.tobytes()]), pa.array([matrix.tobytes()])], names=["block", "ids", "vectors"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, many - held)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                vectors.append(_unit(as_matrix(part.column(1))))
                at, held = at + part.num_rows, held + part.num_rows
                if held >= many:
                    yield made()
                    block, ids, vectors, held = block + 1, [], [], 0
        if held:
            yield made()

    return rows.mapInArrow(pack, "block long, ids binary, vectors binary")


class _Best:
    """The ``most`` nearest entries of each query of a block among those seen so far; ties by idx."""

    def __init__(self, names: np.ndarray, queries: np.ndarray, most: int):
        self.names, self.queries, self.floats, self.most = names, queries, queries.astype(np.float32), most
        self.sim, self.idx = np.full((len(names), most), -np.inf), np.full((len(names), most), np.iinfo(np.int64).max)
        self.margin = (queries.shape[1] + 4) * 2.0**-23  # more than floats and the rounding of results can be wrong
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.room = np.empty(TILE, np.float32), np.empty(TILE, bool)  # kept, as new pages cost more than the sums in them

    def see(self, idx: np.ndarray, entries: np.ndarray) -> None:
        floats = entries.astype(np.float32)
        for b in range(0, len(idx), TILE[1]):
            part = floats[b : b + TILE[1]].T
            for a in range(0, len(self.names), TILE[0]):
                some = self.floats[a : a + TILE[0]]
                near = np.matmul(some, part, out=self.room[0][: len(some), : part.shape[1]])
                least = (self.sim[a : a + TILE[0], -1] - self.margin).astype(np.float32)
                if self.most < near.shape[1] and (new := np.flatnonzero(np.isinf(least))).size:
                    least[new] = np.partition(near[new], -self.most, axis=1)[:, -self.most] - 2 * self.margin
                rows = np.flatnonzero(near.max(axis=1) >= least)
                if rows.size:
                    found = near if len(rows) == len(near) else near[rows]
                    hit = np.greater_equal(found, least[rows, None], out=self.room[1][: len(rows), : near.shape[1]])
                    r, c = np.divmod(np.flatnonzero(hit), near.shape[1])
                    r, c = a + rows[r], b + c
                    self.more.append((r, idx[c], np.round(np.einsum("ij,ij->i", self.queries[r], entries[c]), _DIGITS)))
                    self.waiting += len(r)
            if self.waiting >= self.most * len(self.names):
                self.merge()

    def merge(self) -> None:
        """Take in what waits; the least of the best rises with it."""
        if self.waiting:
            row, idx, sim = (np.concatenate(x) for x in zip(*self.more, strict=True))
            touched = np.unique(row)
            row = np.concatenate([np.repeat(touched, self.most), row])
            idx, sim = np.concatenate([self.idx[touched].ravel(), idx]), np.concatenate([self.sim[touched].ravel(), sim])
            by = np.lexsort((idx, -sim, row))
            row, idx, sim = row[by], idx[by], sim[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < self.most
            self.idx[touched], self.sim[touched] = idx[keep].reshape(-1, self.most), sim[keep].reshape(-1, self.most)
            self.more, self.waiting = [], 0


def _grid(asked: DataFrame, entries: DataFrame, dim: int, most: int) -> DataFrame:
    """``dense_topk`` of any number of queries."""
    index = materialize(_packed(entries, dim, BLOCK_BYTES, most), "index")
    queries = materialize(_packed(asked, dim, BLOCK_BYTES // 2), "queries")
    # dealt out once each: every task reads its queries and its part of the index, and sends no vectors on
    right = index.select(F.col("ids").alias("their_ids"), F.col("vectors").alias("their_vectors")).repartition(max(1, -(-index.count() // PART_BLOCKS)))
    left = queries.repartition(max(1, min(queries.count(), 4 * asked.sparkSession.sparkContext.defaultParallelism)))

    def meet(batches):
        at, best = None, None

        def made():
            best.merge()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, best.names.tobytes(), best.idx.tobytes(), best.sim.tobytes())], names=["block", "ids", "idx", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                ids, vectors, their_ids, their_vectors = (batch.column(k)[i].as_buffer() for k in range(1, 5))
                if block != at:  # rows of one block of queries follow each other
                    if best is not None:
                        yield made()
                    at, best = block, _Best(np.frombuffer(ids, np.int64).copy(), np.frombuffer(vectors).reshape(-1, dim).copy(), most)
                best.see(np.frombuffer(their_ids, np.int64), np.frombuffer(their_vectors).reshape(-1, dim))
        if best is not None:
            yield made()

    def merged(table: pa.Table) -> pa.Table:
        """The best of a block of queries over all parts of the index."""
        ids = np.frombuffer(table["ids"][0].as_buffer(), np.int64)
        idx, sim = (np.concatenate([np.frombuffer(x.as_buffer(), kind).reshape(len(ids), most) for x in table[c]], axis=1) for c, kind in (("idx", np.int64), ("sim", np.float64)))
        by = np.lexsort((idx, -sim), axis=1)[:, :most]
        idx, sim = np.take_along_axis(idx, by, 1), np.take_along_axis(sim, by, 1)
        row, rank = np.nonzero(sim > -np.inf)
        return pa.table({"query_id": ids[row], "idx": idx[row, rank], "sim": sim[row, rank], "rank": (rank + 1).astype(np.int32)})

    return left.crossJoin(right).mapInArrow(meet, "block long, ids binary, idx binary, sim binary").groupBy("block").applyInArrow(merged, f"{_NEAREST}, rank int")


def _nearest(names: np.ndarray, matrix: np.ndarray, idx: np.ndarray, entries: np.ndarray, most: int) -> pa.RecordBatch:
    """Each query's ``most`` best of a block of entries; ties by idx."""
    order = np.argsort(idx, kind="stable")
    idx, entries = idx[order], entries[order]
    few = min(most, len(idx))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, HELD // max(1, len(idx)))
    for at in range(0, len(names), step):
        sim = np.round(matrix[at : at + step] @ entries.T, _DIGITS)
        if few < len(idx):
            least = np.partition(sim, len(idx) - few, axis=1)[:, len(idx) - few]
            rows, columns = np.nonzero(sim >= least[:, None])  # with all that equal the last
        else:
            rows, columns = (x.ravel() for x in np.indices(sim.shape))
        values = sim[rows, columns]
        by = np.lexsort((columns, -values, rows))
        rows, columns, values = rows[by], columns[by], values[by]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < few
        found.append((names[at + rows[keep]], idx[columns[keep]], values[keep]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "idx", "sim"])


def dense_rank(queries: DataFrame, index: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, query_id, idx, sim, rank) of all entries of the query's scope: an equi-join on the scope, ties by idx."""
    pairs = queries.select(*scope, "query_id", F.col("embedding").alias("__q")).join(index.select(*scope, "idx", F.col("embedding").alias("__e")), scope)
    order = Window.partitionBy(*scope, "query_id").orderBy(F.desc("sim"), "idx")
    return pairs.withColumn("sim", F.round(V.cosine(F.col("__q"), F.col("__e")), _DIGITS)).drop("__q", "__e").withColumn("rank", F.row_number().over(order))


def negation_terms(queries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(query_id, term, qtf) of the fixed marker words, for queries that speak of a restriction."""
    text = F.lit(" ".join(C.NEGATION_MARKERS))
    return query_terms(queries.where(T.is_negation(F.col("text"))).withColumn("text", text), scope)


def rrf(rankings: list[tuple[DataFrame, float]], scope: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(scope, query_id, idx, rrf_score, cand_rank): weighted reciprocal rank fusion; ties keep the order of the first ranking."""
    part = [*(scope or []), "query_id"]
    every = None
    for k, (ranking, weight) in enumerate(rankings):
        rows = ranking.select(*part, "idx", (F.lit(float(weight)) / (C.RRF_K + F.col("rank"))).alias("w"), F.struct(F.lit(k).alias("k"), F.col("rank")).alias("seen"))
        every = rows if every is None else every.union(rows)
    fused = every.groupBy(*part, "idx").agg(F.round(F.sum("w"), 12).alias("rrf_score"), F.min("seen").alias("seen"))
    order = Window.partitionBy(*part).orderBy(F.desc("rrf_score"), "seen", "idx")
    out = fused.withColumn("cand_rank", F.row_number().over(order)).drop("seen")
    return out.where(F.col("cand_rank") <= most) if most else out


def hybrid(dense: DataFrame, lexical: DataFrame | None, negation: DataFrame | None = None, scope: list[str] | None = None, most: int = C.CANDIDATES) -> DataFrame:
    """Candidates from up to three rankings; without a lexical one the dense weight takes its share."""
    if lexical is None:
        return rrf([(dense, C.DENSE_WEIGHT + C.BM25_WEIGHT)], scope, most)
    rankings = [(dense, C.DENSE_WEIGHT), (lexical, C.BM25_WEIGHT)]
    return rrf([*rankings, (negation, C.NEGATION_WEIGHT)] if negation is not None else rankings, scope, most)


# ---------------------------------------------------------------- pages


def node_pages(cut: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, page, n, first_idx): sentences of a chunk by page; a table counts once on its page."""
    out = cut.groupBy("doc_id", F.concat(F.lit("chunk::"), "chunk_no").alias("node_id"), "page").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    if tables is not None:
        out = out.union(tables.select("doc_id", F.col("table_id").alias("node_id"), "page", F.lit(1).cast("long"), F.lit(0)))
    return out


def with_fallback_page(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of candidates (doc_id, node_id, page as stored); a node without any has its stored page, if that is known."""
    c = candidates.withColumnRenamed("page", "__own").join(pages, ["doc_id", "node_id"], "left")
    return c.withColumn("page", F.coalesce("page", "__own")).withColumn("n", F.coalesce("n", F.lit(1))).withColumn("first_idx", F.coalesce("first_idx", F.lit(0))).drop("__own").where("page is not null")


def page_fractions(pages: DataFrame) -> DataFrame:
    """With ``fraction`` of the node's sentences."""
    return pages.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id", "node_id")))


def page_summary(pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, primary_page, page_range, page_distribution): the page with most sentences, of equals the first seen."""
    rows = page_fractions(pages).groupBy("doc_id", "node_id").agg(
        F.max_by("page", F.struct("n", -F.col("first_idx"))).alias("primary_page"),
        F.min("page").alias("__low"), F.max("page").alias("__high"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "fraction")))).alias("page_distribution"),
    )
    return rows.withColumn("page_range", F.when(F.col("__low") == F.col("__high"), F.col("__low").cast("string")).otherwise(F.concat_ws("-", "__low", "__high"))).drop("__low", "__high")


def first_captions(tables: DataFrame) -> DataFrame:
    """(doc_id, section_no, table_caption): of the first table of each section."""
    return tables.where("section_no is not null").groupBy("doc_id", "section_no").agg(F.min_by("caption", F.struct("page", "t_idx")).alias("table_caption"))


def context_block(section: Column, core: Column, table_caption: Column) -> Column:
    def filled(x: Column) -> Column:
        return F.coalesce(F.length(x) > 0, F.lit(False))

    return F.concat_ws(" ", F.when(filled(section), F.concat(F.lit("[Section: "), section, F.lit("]"))), F.when(filled(core), core), F.when(filled(table_caption) & ~table_caption.eqNullSafe(core), F.concat(F.lit("[Table: "), table_caption, F.lit("]"))))


def vote_pages(votes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, query_id, page, score) of (doc_id, query_id, node_id, rrf_score, section_sim, table_caption).

    A candidate's vote is its fused score, plus fixed bonuses for a section like the query and for a captioned table in
    the section, spread over its pages.
    """
    vote = F.col("rrf_score") * C.VOTE_CHUNK + F.when(F.col("section_sim") >= C.SECTION_SIMILARITY, C.VOTE_SECTION).otherwise(0.0) + F.when(F.length("table_caption") > 0, C.VOTE_TABLE).otherwise(0.0)
    spread = votes.withColumn("__vote", vote).join(page_fractions(pages), ["doc_id", "node_id"])
    return spread.groupBy("doc_id", "query_id", "page").agg(F.round(F.sum(F.col("__vote") * F.col("fraction")), 12).alias("score"))


def rerank_pages(candidates: DataFrame, pages: DataFrame, scorer: Scorer = overlap_scorer) -> DataFrame:
    """(doc_id, query_id, page, score): the best of scorer's probability times fraction, over (query_id, query, node_id, context)."""
    scored = candidates.withColumn("__p", V.sigmoid(scorer(F.col("query"), F.col("context"))))
    return scored.join(page_fractions(pages), ["doc_id", "node_id"]).groupBy("doc_id", "query_id", "page").agg(F.round(F.max(F.col("__p") * F.col("fraction")), 12).alias("score"))


def best_nodes(candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """(doc_id, query_id, page, node_id): for each page the first candidate whose primary page it is."""
    rows = candidates.join(summary, ["doc_id", "node_id"])
    return rows.groupBy("doc_id", "query_id", F.col("primary_page").alias("page")).agg(F.min_by("node_id", "cand_rank").alias("node_id"))


def top_pages(scores: DataFrame, best: DataFrame, most: int = C.TOP_K, dense: bool = False) -> DataFrame:
    """(doc_id, query_id, rank, page, score, normalized_score, node_id).

    The ``most`` best pages are ranked first, ties by page; pages that are no candidate's primary page then go and leave
    a gap in the ranks, unless ``dense``.
    """
    part = Window.partitionBy("doc_id", "query_id")
    ranked = scores.withColumn("rank", F.row_number().over(part.orderBy(F.desc("score"), "page"))).where(F.col("rank") <= most)
    found = ranked.join(best, ["doc_id", "query_id", "page"]).withColumn("score", V.rounded(F.col("score"), 4))
    if dense:
        found = found.withColumn("rank", F.row_number().over(part.orderBy("rank")))
    return min_max(found)


def min_max(rows: DataFrame) -> DataFrame:
    """With ``normalized_score`` over the rows of a query; 0 where all scores are equal."""
    part = Window.partitionBy("doc_id", "query_id")
    low, span = F.min("score").over(part), F.max("score").over(part) - F.min("score").over(part)
    return rows.withColumn("normalized_score", F.round((F.col("score") - low) / F.when(span > 0, span).otherwise(1.0), 4))
