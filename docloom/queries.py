"""The registered queries: each operator on the whole tables. ``oracle`` states the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import plugins
from .functions import text as T
from .operators import cite, expand, generate, graph, index, layout, render, retrieve, select
from .plans import engine, fixtures
from .sources import documents as S
from .storage import materialize
from .streaming.ingest import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents")


# ---------------------------------------------------------------- text


@query
def clean_text(spark, sf_dir):
    return fixtures.hyphenated(_docs(spark, sf_dir)).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query
def split_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def tokenize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query
def highlight_terms(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.highlight_terms(F.col("text")), " ").alias("terms"))


@query
def html_escape(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


@query
def hash_embedding(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(plugins.hash_embedder(F.col("text"))).alias("bucket", "value"))
    return rows.where("value <> 0").select("doc_id", "bucket", F.round(F.col("value").cast("double"), 5).alias("value"))


# ---------------------------------------------------------------- layout


@query
def column_histogram(spark, sf_dir):
    return layout.column_histogram(fixtures.words(_docs(spark, sf_dir)), fixtures.WIDTH)


@query
def detect_columns(spark, sf_dir):
    return layout.detect_columns(fixtures.words(_docs(spark, sf_dir)), fixtures.WIDTH)


def _assembled(spark, sf_dir):
    return layout.assemble_lines(layout.split_columns(fixtures.words(_docs(spark, sf_dir)), fixtures.WIDTH))


@query
def line_assembly(spark, sf_dir):
    return _assembled(spark, sf_dir).withColumn("size", F.round("size", 6))


@query
def modal_size(spark, sf_dir):
    return layout.modal_sizes(_assembled(spark, sf_dir))


@query
def heading_level(spark, sf_dir):
    return fixtures.levelled(_docs(spark, sf_dir)).where("level is not null").select("doc_id", "line_no", "level")


@query
def table_area_mask(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return layout.outside_tables(fixtures.lines(docs), fixtures.tables(docs)).select("doc_id", "line_no", "page")


@query
def caption_band(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return layout.captions(fixtures.tables(docs), fixtures.lines(docs)).select("doc_id", "page", "t_idx", "caption")


@query
def infer_title(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return layout.titles(docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Title "), "doc_id")).when(F.col("doc_id") % 4 == 1, "abc").alias("meta_title")), fixtures.lines(docs))


@query
def reference_guard(spark, sf_dir):
    return layout.guard_references(fixtures.levelled(_docs(spark, sf_dir))).select("doc_id", "line_no")


@query
def section_fragments(spark, sf_dir):
    return fixtures.fragments(_docs(spark, sf_dir)).withColumn("sentences", F.array_join("sentences", "|"))


@query
def extracted_sections(spark, sf_dir):
    """The whole way from words on pages, with tables, to section fragments."""
    docs = _docs(spark, sf_dir)
    _, found, _ = layout.extract(fixtures.words(docs), fixtures.tables(docs), fixtures.WIDTH)
    return found.withColumn("sentences", F.array_join("sentences", "|"))


# ---------------------------------------------------------------- graph


@query
def section_merge(spark, sf_dir):
    return fixtures.merged(_docs(spark, sf_dir)).select("doc_id", "page", "frag_seq", "section_no")


@query
def section_hierarchy(spark, sf_dir):
    return graph.sections(fixtures.merged(_docs(spark, sf_dir)))


@query
def active_section(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return graph.active_sections(fixtures.lines(docs), fixtures.merged(docs))


@query
def page_links(spark, sf_dir):
    return graph.page_links(fixtures.lines(_docs(spark, sf_dir)))


@query
def sentence_links(spark, sf_dir):
    return graph.sentence_links(graph.sentences(fixtures.merged(_docs(spark, sf_dir))))


@query
def semantic_chunks(spark, sf_dir):
    return graph.chunk_numbers(fixtures.vectors(spark, sf_dir), ["label"], "idx").select("label", "idx", "chunk_in_part")


def corpus_graph(spark: SparkSession, sf_dir: str) -> engine.Graph:
    """The graph of all documents, read as lines."""
    docs = _docs(spark, sf_dir)
    pages = fixtures.lines(docs).select("doc_id", "page").distinct()
    tables = layout.captions(fixtures.tables(docs), fixtures.lines(docs))
    pages = materialize(pages, "pages")
    stems = docs.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("stem"), F.lit("").alias("title"))
    return engine.build(stems, pages, fixtures.fragments(docs), tables)


@query
def graph_type_counts(spark, sf_dir):
    return graph.type_counts(corpus_graph(spark, sf_dir).nodes())


@query
def graph_relation_counts(spark, sf_dir):
    return corpus_graph(spark, sf_dir).edges().groupBy("relation").agg(F.count("*").alias("n"))


@query
def induced_subgraph(spark, sf_dir):
    g = corpus_graph(spark, sf_dir)
    _, inside = graph.induced_subgraph(g.nodes(), g.edges(), 12)
    return inside.groupBy("relation").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- index and rankings


@query
def term_stats(spark, sf_dir):
    return index.build_bm25(_docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, sf_dir, most=None):
    bm25 = index.build_bm25(_docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text"))
    asked = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.floor_and_rank(retrieve.bm25_scores(retrieve.query_terms(asked), bm25), most=most)


@query
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).withColumn("score", F.round("score", 4))


@query
def bm25_threshold(spark, sf_dir):
    return _bm25(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n_kept"), F.round(F.min("score"), 4).alias("low"))


@query
def corpus_mean(spark, sf_dir):
    return index.corpus_mean(fixtures.vectors(spark, sf_dir)).select(F.posexplode("mean").alias("pos", "mean")).withColumn("mean", F.round("mean", 9))


@query
def dense_topk(spark, sf_dir):
    return retrieve.dense_topk(fixtures.vector_queries(spark, sf_dir), fixtures.vectors(spark, sf_dir), 10).withColumn("sim", F.round("sim", 6))


@query
def negation_detect(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_negation(F.col("text")).alias("negated"))


@query
def negation_rank(spark, sf_dir):
    bm25 = index.build_bm25(fixtures.marked(_docs(spark, sf_dir)).select(F.col("doc_id").alias("idx"), "text"))
    asked = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("what is not allowed "), "text").alias("text"))
    return retrieve.floor_and_rank(retrieve.bm25_scores(retrieve.negation_terms(asked), bm25), most=20).withColumn("score", F.round("score", 4))


def _rankings(spark, sf_dir):
    vectors, asked = fixtures.vectors(spark, sf_dir), fixtures.vector_queries(spark, sf_dir)
    same = asked.select("query_id", "label").join(vectors.select("idx", "label"), "label")
    order = Window.partitionBy("query_id").orderBy("idx")
    return retrieve.dense_topk(asked, vectors, 30), same.withColumn("rank", F.row_number().over(order)).where("rank <= 30")


@query
def rrf_fuse(spark, sf_dir):
    a, b = _rankings(spark, sf_dir)
    return retrieve.rrf([(a, 0.6), (b, 0.4)]).withColumn("rrf_score", F.round("rrf_score", 9))


@query
def hybrid_topk(spark, sf_dir):
    a, b = _rankings(spark, sf_dir)
    return retrieve.hybrid(a, b).withColumn("rrf_score", F.round("rrf_score", 9))


# ---------------------------------------------------------------- pages and results


def _pages(spark, sf_dir):
    return retrieve.node_pages(fixtures.cut(_docs(spark, sf_dir)))


@query
def page_distribution(spark, sf_dir):
    return retrieve.page_fractions(_pages(spark, sf_dir)).select("doc_id", "node_id", "page", "n", F.round("fraction", 9).alias("fraction"))


@query
def primary_page(spark, sf_dir):
    return retrieve.page_summary(_pages(spark, sf_dir)).select("doc_id", "node_id", "primary_page")


@query
def page_range(spark, sf_dir):
    return retrieve.page_summary(_pages(spark, sf_dir)).select("doc_id", "node_id", "page_range")


def _votes(spark, sf_dir):
    """Each chunk as a candidate of its document, ranked by number."""
    chunks = fixtures.cut(_docs(spark, sf_dir)).select("doc_id", "chunk_no").distinct()
    return chunks.select("doc_id", F.lit(1).alias("query_id"), F.concat(F.lit("chunk::"), "chunk_no").alias("node_id"), (F.col("chunk_no") + 1).alias("cand_rank"), (1.0 / (F.col("chunk_no") + 61)).alias("rrf_score"), (F.col("chunk_no") % 10 / 10).alias("section_sim"), F.when(F.col("chunk_no") % 3 == 0, "T").otherwise("").alias("table_caption"))


@query
def page_votes(spark, sf_dir):
    return retrieve.vote_pages(_votes(spark, sf_dir), _pages(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _fixture_chunks(spark, sf_dir):
    cut = fixtures.cut(_docs(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    first = F.min_by("text", "idx").over(Window.partitionBy("doc_id"))
    return cut.withColumn("query", first).groupBy("doc_id", "chunk_no", "query").agg(text.alias("context"))


@query
def ce_page_max(spark, sf_dir):
    cand = _fixture_chunks(spark, sf_dir).select("doc_id", F.lit(1).alias("query_id"), F.concat(F.lit("chunk::"), "chunk_no").alias("node_id"), "query", "context")
    return retrieve.rerank_pages(cand, _pages(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query
def result_assembly(spark, sf_dir):
    votes, pages = _votes(spark, sf_dir), _pages(spark, sf_dir)
    return retrieve.top_pages(retrieve.vote_pages(votes, pages), retrieve.best_nodes(votes, retrieve.page_summary(pages)))


@query
def context_block(spark, sf_dir):
    rows = _fixture_chunks(spark, sf_dir)
    section, caption = F.when(F.col("chunk_no") % 2 == 0, F.col("query")), F.when(F.col("chunk_no") % 3 == 0, F.concat(F.lit("Table "), "chunk_no")).when(F.col("chunk_no") % 3 == 1, F.col("context"))
    return rows.select("doc_id", "chunk_no", retrieve.context_block(section, F.col("context"), caption).alias("block"))


# ---------------------------------------------------------------- neighbours, choice, answers


def _origins(chunks):
    return chunks.select("doc_id", F.lit(1).alias("query_id"), F.col("chunk_id").alias("origin_id"))


@query
def siblings(spark, sf_dir):
    chunks = fixtures.fragment_chunks(_docs(spark, sf_dir))
    return expand.siblings(_origins(chunks), chunks)


@query
def cousins(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = fixtures.fragment_chunks(docs)
    return expand.cousins(_origins(chunks), chunks, graph.sections(fixtures.merged(docs)))


@query
def neighbourhood(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = fixtures.fragment_chunks(docs)
    return expand.neighbourhood(_origins(chunks), chunks, graph.sections(fixtures.merged(docs)))


@query
def sentence_window(spark, sf_dir):
    """Every filled line, walked from within its page."""
    cut = fixtures.cut(_docs(spark, sf_dir))
    rows = cut.select("doc_id", F.col("page").alias("section_no"), F.col("idx").alias("chunk_no"), F.concat(F.lit("chunk::"), "idx").alias("chunk_id"), plugins.hash_embedder(F.col("text")).alias("embedding"))
    rows = materialize(rows, "lines")
    return expand.window(_origins(rows), rows)


def _mmr_candidates(spark, sf_dir):
    asked, vectors = fixtures.vector_queries(spark, sf_dir), fixtures.vectors(spark, sf_dir)
    best = retrieve.dense_topk(asked, vectors, 30)
    return best.join(vectors, "idx").select(F.lit(0).cast("long").alias("doc_id"), "query_id", F.col("rank").alias("seq"), F.concat(F.lit("v"), "idx").alias("node_id"), F.col("sim").alias("query_sim"), "embedding")


@query
def mmr_select(spark, sf_dir):
    return select.mmr_select(_mmr_candidates(spark, sf_dir)).select("query_id", "mmr_rank", "node_id", F.round("query_sim", 6).alias("query_sim"), F.round("mmr_score", 6).alias("mmr_score"))


@query
def assemble_context(spark, sf_dir):
    rows = _fixture_chunks(spark, sf_dir).select("doc_id", (F.col("chunk_no") + 1).alias("mmr_rank"), F.when(F.col("chunk_no") % 3 == 0, " Alpha ").when(F.col("chunk_no") % 3 == 1, "").otherwise("Beta").alias("section"), F.col("context").alias("text"), F.when(F.col("chunk_no") % 4 > 0, F.col("chunk_no")).alias("page"))
    return generate.assemble_context(rows, ["doc_id"])


def _assistant(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "conversations").where("role = 'assistant'")


@query
def split_claims(spark, sf_dir):
    rows = _assistant(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.concat("text", F.lit(" See Fig. 3 of Dr. Who. And so on.")).alias("text"))
    return generate.split_claims(rows, "answer_id")


def _turns(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return fixtures.table(spark, sf_dir, "conversations").withColumn("before", before).where("before is not null").select("conv_id", "turn", T.keyword_jaccard(T.keywords(F.col("text")), T.keywords(F.col("before"))).alias("jaccard"))


@query
def keyword_jaccard(spark, sf_dir):
    return _turns(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 9))


@query
def citation_stats(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", (F.col("jaccard") >= 0.02).alias("cited"), F.col("jaccard").alias("score"), F.when(F.col("turn") % 2 == 0, F.col("jaccard")).alias("ce_score"), F.col("jaccard").alias("keyword_sim"))
    return cite.citation_stats(rows, "conv_id")


def _cited(spark, sf_dir):
    turns = _assistant(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "text")
    claims = generate.split_claims(turns, "answer_id")
    entries = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), F.concat(F.lit("doc::"), "doc_id").alias("node_id"), "text", F.lit(1).alias("page"), F.col("source").alias("section"), plugins.hash_embedder(F.col("text")).alias("embedding"))
    return cite.cite_claims(claims, entries)


@query
def cite_claims(spark, sf_dir):
    return _cited(spark, sf_dir).select("answer_id", "claim_no", "cited", "score", "ce_score", "keyword_sim", "matched_node", "citation")


@query
def cited_sources(spark, sf_dir):
    return cite.sources(_cited(spark, sf_dir)).withColumn("source_pages", F.array_join(F.col("source_pages").cast("array<string>"), ","))


@query
def search_results(spark, sf_dir):
    """The first sentence of every document, asked of that document."""
    docs = _docs(spark, sf_dir)
    asked = docs.select("doc_id", F.col("doc_id").alias("query_id"), F.get(T.sentences(F.col("text")), 0).alias("text"))
    asked = materialize(asked, "questions").where("text is not null")
    found = engine.search(corpus_graph(spark, sf_dir), asked)
    return render.result_text(found.results)


@query
def web_lines(spark, sf_dir):
    return S.web_lines(fixtures.table(spark, sf_dir, "pages"))


@query
def event_window_totals(spark, sf_dir):
    return event_windows(fixtures.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
