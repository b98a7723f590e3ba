"""The engine on hand-written inputs, the literal document, and properties."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom import constants as C
from docloom import plugins
from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import cite, expand, generate, graph, index, layout, render, retrieve, select, store
from docloom.plans import engine
from docloom.sources import documents as S


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Smith left. Then he came back.", ["Dr. Smith left.", "Then he came back."]),
        ("Too short.", ["Too short."]),
        ("See e.g. Figure one here. (Next sentence starts.)", ["See e.g. Figure one here.", "(Next sentence starts.)"]),
        ("Short. This one is long enough.", ["This one is long enough."]),
        ("   ", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences) == want


def test_clean_text(spark):
    assert one(spark, "meth-  od", T.clean_text) == "method"
    assert one(spark, " a\n b\t c ", T.clean_text) == "a b c"


def test_tokens(spark):
    assert one(spark, "Über-cool x_1 'don't'", T.tokens) == ["über-cool", "x_1", "don", "t"]


def test_claims(spark):
    assert one(spark, "See Fig. 3 now. It works. Dr. Who left.", T.claims) == ["See Fig. 3 now.", "It works.", "Dr. Who left."]
    assert one(spark, "  ", T.claims) == []


@pytest.mark.parametrize(("text", "want"), [("It is NOT so", True), ("nothing", False), ("an unauthorised use", True), ("restricted area", True), (None, False)])
def test_negation(spark, text, want):
    assert one(spark, text, T.is_negation) is want


def test_highlights_and_links(spark):
    assert one(spark, "The big RED-fox and the big fox of X1_y", T.highlight_terms) == ["big", "red-fox", "fox", "x1_y"]
    assert one(spark, "some longer words appear inside", T.highlight_phrases) == ["longer", "words", "appear"]
    assert one(spark, "text [p. 12]", T.link_citations) == 'text <a href="page:12">[p. 12]</a>'
    assert one(spark, "a<b>&\"c", T.html_escape) == "a&lt;b&gt;&amp;&quot;c"
    link = one(spark, "A & B c", lambda c: T.link(F.lit(4), c))
    back = one(spark, link, T.parse_link)
    assert (back["scheme"], back["page"], back["section"]) == ("page", 4, "A & B c")


@pytest.mark.parametrize(
    ("line", "want"),
    [((14.0, False, False, "Heading"), 1), ((12.0, True, False, "Heading"), 1), ((11.5, False, False, "Heading"), None), ((11.5, False, True, "HEAD"), 2), ((10.0, True, True, "HEAD"), 3), ((20.0, True, True, "12"), None), ((20.0, True, True, "A 1"), None)],
)
def test_heading_level(spark, line, want):
    row = spark.createDataFrame([line], "size double, bold boolean, upper boolean, text string")
    assert row.select(layout.heading_level(*(F.col(c) for c in row.columns), F.lit(10.0)).alias("x")).first()["x"] == want


def test_modal_size_takes_the_first_of_equals(spark):
    rows = [(1, 1, 0, i, s) for i, s in enumerate([10.0, 12.0, 12.0, 10.0])]
    assert layout.modal_sizes(spark.createDataFrame(rows, "doc_id long, page int, col int, line_no int, size double")).first()["body_size"] == 10.0


def test_lines_follow_the_word_before(spark):
    words = [(1, 1, 0, i, w, x, t, t + 9, 10.0, f) for i, (w, x, t, f) in enumerate([("a", 0.0, 0.0, "Bold"), ("b", 10.0, 3.0, "x"), ("c", 20.0, 6.0, "x"), ("d", 0.0, 20.0, "x")])]
    df = spark.createDataFrame(words, "doc_id long, page int, col int, word_id long, text string, x0 double, top double, bottom double, size double, fontname string")
    got = [(r.text, r.bold) for r in layout.assemble_lines(df).orderBy("line_no").collect()]
    assert got == [("a b c", True), ("d", False)]  # drift of three points a word never breaks a line


def test_sections_by_a_stack_of_levels(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for doc in range(60):
        stack, levels = {}, [rng.randint(1, 3) for _ in range(12)]
        for i, level in enumerate(levels, 1):
            stack = {k: v for k, v in stack.items() if k < level}
            want[doc, i] = stack[max(stack)] if stack else None
            stack[level] = i
            rows.append((doc, 1, i, f"h{i}", level))
    df = spark.createDataFrame(rows, "doc_id long, page int, frag_seq long, heading string, level int")
    got = {(r.doc_id, r.section_no): r.parent_no for r in graph.sections(graph.merge_sections(df)).collect()}
    assert got == want


def test_chunks_are_capped(spark):
    rows = spark.createDataFrame([(1, i, [1.0, 0.0]) for i in range(17)], "part int, i int, embedding array<float>")
    sizes = graph.chunk_numbers(rows, ["part"], "i").groupBy("chunk_in_part").count().orderBy("chunk_in_part").collect()
    assert [r["count"] for r in sizes] == [8, 8, 1]


def test_page_summary(spark):
    rows = spark.createDataFrame([(1, "a", 4, 4, 0), (1, "a", 5, 2, 4), (1, "b", 2, 1, 9), (1, "b", 3, 1, 3)], "doc_id long, node_id string, page int, n long, first_idx int")
    got = {r.node_id: r for r in retrieve.page_summary(rows).collect()}
    assert (got["a"].primary_page, got["a"].page_range) == (4, "4-5")
    assert {k: round(v, 3) for k, v in got["a"].page_distribution.items()} == {4: 0.667, 5: 0.333}
    assert got["b"].primary_page == 3  # of equals the one seen first


def test_rrf(spark):
    dense = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "query_id long, idx int, rank int")
    lexical = spark.createDataFrame([(1, 1, 1)], "query_id long, idx int, rank int")
    got = {r.idx: r.rrf_score for r in retrieve.hybrid(dense, lexical).collect()}
    assert got == {0: pytest.approx(0.6 / 61), 1: pytest.approx(0.6 / 62 + 0.4 / 61)}
    assert retrieve.hybrid(dense, None).where("idx = 0").first()["rrf_score"] == pytest.approx(1 / 61)


def test_dense_topk_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    asked = rows.where("idx % 50 = 0").select(F.col("idx").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.idx for r in retrieve.dense_topk(asked, rows.repartition(7), 5).collect()}
    data = rows.orderBy("idx").toPandas()
    m = np.array(data["embedding"].tolist(), float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in data["idx"][data["idx"] % 50 == 0]:
        sims = np.round(m @ m[data["idx"] == q][0], 9)
        assert [got[q, k + 1] for k in range(5)] == data["idx"].to_numpy()[np.lexsort((data["idx"], -sims))[:5]].tolist()


def test_dense_topk_without_queries(spark):
    empty = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert retrieve.dense_topk(empty, spark.createDataFrame([(1, [1.0])], "idx long, embedding array<float>"), 3).count() == 0


def test_bm25_negative_idf(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "a d")], "idx long, text string")
    idf = {r.term: r.idf for r in index.build_bm25(rows).terms.collect()}
    plain = {t: np.log(3 - n + 0.5) - np.log(n + 0.5) for t, n in (("a", 3), ("b", 1), ("c", 1), ("d", 1))}
    assert idf["a"] == pytest.approx(0.25 * np.mean(list(plain.values())))
    assert idf["b"] == pytest.approx(plain["b"])


def test_window_stops_at_the_first_unlike_chunk(spark):
    rows = [(1, 1, i, f"c{i}", e) for i, e in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])]
    chunks = spark.createDataFrame(rows, "doc_id long, section_no int, chunk_no int, chunk_id string, embedding array<float>")
    origin = spark.createDataFrame([(1, 1, "c0")], "doc_id long, query_id long, origin_id string")
    assert [r.neighbour_id for r in expand.window(origin, chunks).collect()] == ["c1"]


def test_mmr_by_brute_force():
    rng = np.random.default_rng(0)
    vectors, sims = rng.normal(size=(20, 6)), rng.random(20)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen = []
    for _ in range(C.MMR_BUDGET):
        scores = {i: C.MMR_LAMBDA * sims[i] - ((1 - C.MMR_LAMBDA) * max(unit[i] @ unit[j] for j in chosen) if chosen else 0) for i in range(20) if i not in chosen}
        chosen.append(max(scores, key=lambda i: (round(scores[i], 9), -i)))
    got = [i for i, _ in select.greedy(sims, vectors, C.MMR_LAMBDA, C.MMR_BUDGET)]
    assert got == chosen
    assert len(set(got)) == len(got)


def test_citations_are_penalised_and_limited(spark):
    rows = [(1, c, f"claim {c}", 1, 7, 0.9, 0.0, 2.0) for c in range(1, 6)] + [(1, 5, "claim 5", 2, 8, 0.6, 0.0, 0.6)]
    df = spark.createDataFrame(rows, "answer_id long, claim_no int, claim string, cand_no int, idx long, ce_score double, keyword_sim double, combined double")
    got = {r.claim_no: (r.cited, r.score, r.idx) for r in cite.cite(df).collect()}
    assert got == {1: (True, 2.0, 7), 2: (True, round(2 / 1.5, 4), 7), 3: (True, 1.0, 7), 4: (False, -1.0, None), 5: (True, 0.6, 8)}


def test_empty_index_cites_nothing(spark):
    claims = spark.createDataFrame([(1, 1, "a claim")], "answer_id long, claim_no int, claim string")
    empty = spark.createDataFrame([], "idx long, node_id string, text string, page int, section string, embedding array<float>")
    row = cite.cite_claims(claims, empty).first()
    assert (row.cited, row.score, row.citation) == (False, None, None)


def test_min_max_of_one_row(spark):
    df = spark.createDataFrame([(1, 1, 0.4)], "doc_id long, query_id long, score double")
    assert retrieve.min_max(df).first()["normalized_score"] == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("z"), V.half_precision(F.array(F.lit(0.1), F.lit(1000.1)).cast("array<float>")).alias("h")).first()
    assert (row.c, row.z) == (pytest.approx(0.96), 0.0)
    assert row.h == [float(np.float16(0.1)), float(np.float16(1000.1))]


def test_unknown_generator():
    with pytest.raises(ValueError, match="unknown generator"):
        plugins.generator("nothing")


def test_generators_over_http_and_in_workers(spark):
    import http.server
    import json
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"response": f" {body['model']}: {body['prompt'].upper()} "}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("hi", ["x"])], "p string, t array<string>")
    try:
        made = plugins.http_generator(f"http://127.0.0.1:{server.server_port}/api", "m")
        assert rows.select(made(F.col("p"), F.col("t")).alias("a")).first()["a"] == "m: HI"
    finally:
        server.shutdown()
    plugins.register("loud", plugins.local_generator(lambda: lambda prompts: [p + "!" for p in prompts]))
    assert rows.select(plugins.generator("loud")(F.col("p"), F.col("t")).alias("a")).first()["a"] == "hi!"
    plugins.GENERATORS.pop("loud")


def test_a_scorer_that_fails_leaves_it_to_votes(spark, demo):
    asked = spark.createDataFrame([(1, 1, "linseed paint in frost")], "doc_id long, query_id long, text string")
    broken = lambda query, text: F.raise_error(F.lit("no model")).cast("double")
    with pytest.warns(UserWarning, match="votes decide"):
        got = engine.search(demo, asked, scorer=broken).results.select("rank", "page", "score").collect()
    assert got == engine.search(demo, asked).results.select("rank", "page", "score").collect()
    assert engine.search(demo, asked, scorer=broken).results.count() == len(got)  # not asked again


def test_answers_need_results(spark, demo):
    asked = spark.createDataFrame([(99, 1, "nothing holds this document")], "doc_id long, query_id long, text string")
    with pytest.raises(ValueError, match="found nothing"):
        engine.answer(demo, engine.search(demo, asked))


def test_a_query_without_text_goes_by_its_best_chunk(spark):
    rows = spark.createDataFrame([("", "a" * 200), ("q", "b")], "q string, c string")
    assert [r.x for r in rows.select(generate.query_label(F.col("q"), F.col("c")).alias("x")).collect()] == ["a" * 120, "q"]


def test_boundary_sentences(demo):
    got = {r.chunk_id: (r.first_sentence, r.last_sentence) for r in expand.boundary_sentences(demo.chunks).collect()}
    assert got == {"chunk::1": ("sentence::1", "sentence::2"), "chunk::2": ("sentence::3", "sentence::4")}


def test_entities(spark):
    import html

    for text in ("a &amp;lt; b", "&eacute;&#233;&#xE9; &nope; &", "x &#128512; &lt;p&gt;&quot;", "plain", ";;&amp;"):
        assert one(spark, text, plugins.unescape) == html.unescape(text), text


@pytest.fixture(scope="module")
def demo(spark):
    documents, fragments, tables = S.demo_fragments(spark)
    return engine.build(documents, fragments.select("doc_id", "page"), fragments, S.raw_tables(tables))


def test_demo_graph(demo):
    nodes, edges = demo.nodes(), demo.edges()
    assert (nodes.count(), edges.count()) == (13, 24)
    assert {r.type: r.n for r in graph.type_counts(nodes).collect()} == {"PDF": 1, "Page": 2, "Section": 2, "Sentence": 4, "Table": 2, "SemanticChunk": 2}
    assert [r.node_id for r in demo.entries.orderBy("idx").collect()] == ["table::1::0", "table::2::0", "chunk::1", "chunk::2"]
    assert demo.tables.where("text = caption").count() == 2
    assert edges.where("relation in ('PARENT_SECTION', 'HAS_SUBSECTION')").count() == 0
    assert render.plot_nodes(nodes).where(F.length("short_label") > 28).count() == 0
    assert render.export_json(nodes, edges).count() == 37


def test_demo_search_answer_and_bundle(spark, demo, tmp_path):
    asked = spark.createDataFrame([(1, 1, "how many winters does linseed paint resist rain and frost"), (1, 2, "which beam depths are not allowed")], "doc_id long, query_id long, text string")
    found, said = engine.ask(demo, asked)
    rows = found.results.orderBy("query_id", "rank").collect()
    assert rows[0].page == 2 and rows[0].normalized_score == 1.0
    assert {r.query_id for r in rows} == {1, 2}
    assert "Query:" in render.result_text(found.results).first()["text"]
    assert render.result_html(found.results).where("html like '%result%'").count() == len(rows)
    claims = said.claims.collect()
    assert claims and {(c.doc_id, c.query_id) for c in claims} == {(1, 1), (1, 2)}
    assert all(c.citation == f"[p. {c.page}]" for c in claims if c.cited)
    assert said.stats.where("total_claims <> n_cited + uncited").count() == 0
    assert said.sources.count() == 2 and render.answer_html(said.claims).count() == 2
    reranked = engine.search(demo, asked, scorer=plugins.overlap_scorer).results
    assert reranked.where("page = 2 and query_id = 1 and rank = 1").count() == 1

    assert set(found.timings) == {"candidate_retrieval_s", "graph_traversal_scoring_s", "result_assembly_s", "total_s"}
    assert set(said.timings) == {"neighbourhood_s", "mmr_s", "generation_s", "citation_s", "total_s"}

    folder = demo.save(str(tmp_path), "demo", "/x/demo.pdf", "abc")
    back = engine.Graph.load(spark, folder, "abc")
    assert back.nodes().count() == 13
    assert sorted(r.text for r in back.entries.collect()) == sorted(r.text for r in demo.entries.collect())
    back.save(str(tmp_path), "demo", "/x/demo.pdf", "abc")  # over the folder it was loaded from
    back = engine.Graph.load(spark, folder, "abc")
    assert back.nodes().count() == 13
    (tmp_path / "demo_kg" / "manifest-9").mkdir()  # a save that broke off
    assert engine.Graph.load(spark, folder, "abc").nodes().count() == 13
    (tmp_path / "demo_kg" / "manifest-9").rmdir()
    assert engine.Graph.load(spark, folder, "other") is None
    listed = store.discover(spark, str(tmp_path)).collect()
    assert [(r.stem, r.node_count, r.index_count) for r in listed] == [("demo", 13, 4)] and listed[0].bytes > 0
    assert not store.delete(spark, folder, str(tmp_path / "elsewhere"))
    assert store.delete(spark, folder, str(tmp_path)) and store.load(spark, folder) is None


def test_one_query_put_to_two_documents(spark):
    parts = [S.demo_fragments(spark, d) for d in (1, 2)]
    documents, fragments, tables = (a.union(b) for a, b in zip(*parts, strict=True))
    both = engine.build(documents, fragments.select("doc_id", "page"), fragments, S.raw_tables(tables))
    asked = spark.createDataFrame([(d, 1, "how long does paint resist frost") for d in (1, 2)], "doc_id long, query_id long, text string")
    _, said = engine.ask(both, asked)
    assert said.answers.count() == said.sources.count() == said.stats.count() == 2
    for rows, names in ((said.chosen, ("node_id",)), (said.claims, ("claim_no",))):
        got = [(r.doc_id, r.query_id, *(r[n] for n in names)) for r in rows.collect()]
        assert len(got) == len(set(got)) and {g[0] for g in got} == {1, 2}
    # the copies are alike, and so are their answers
    assert len({r.answer for r in said.answers.collect()}) == 1


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_dense_topk_in_a_grid_of_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieve, "QUERY_BYTES", sent)
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 8 * 6 * 10)  # ten vectors a block
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (90, 6)).astype(float)  # many ties, and vectors without length
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "idx long, embedding array<float>").repartition(4)
    asked = df.where("idx % 3 = 0").select(F.col("idx").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.idx for r in retrieve.dense_topk(asked, df, 7).collect()}
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(size > 0, size, 1)
    for q in range(0, 90, 3):
        assert [got[q, k + 1] for k in range(7)] == np.lexsort((np.arange(90), -np.round(unit @ unit[q], 9)))[:7].tolist()


def test_grid_deals_one_block_of_the_index_to_many_tasks(spark, monkeypatch):
    """Queries and index both split the work, and no vector is sent twice by a shuffle; ties and copies stay exact."""
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 0)
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.normal(size=(1500, 6)), np.repeat(rng.normal(size=(1, 6)), 1500, axis=0)])
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 8 * 6 * 4000)  # the index is one block, the queries are two
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "idx long, embedding array<double>").repartition(1)
    asked = df.where("idx < 1400 or idx = 2999").select(F.col("idx").alias("query_id"), "embedding").repartition(8)
    seen = []
    monkeypatch.setattr(retrieve, "materialize", lambda df, name, kept=retrieve.materialize: seen.append((name, out := kept(df, name))) or out)
    best = retrieve.dense_topk(asked, df, 5)
    got = {(r.query_id, r["rank"]): r.idx for r in best.collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in (*range(0, 1400, 50), 2999):
        assert [got[q, k + 1] for k in range(5)] == np.lexsort((np.arange(3000), -np.round(unit @ unit[q], 9)))[:5].tolist()
    assert [got[2999, k + 1] for k in range(5)] == [1500, 1501, 1502, 1503, 1504]
    blocks = dict(seen)
    assert sum(len(r.ids) // 8 for r in blocks["index"].collect()) == 1505  # of the copies, five can be among five best
    assert best.select(F.spark_partition_id().alias("p")).count() == 5 * 1401
    assert "CartesianProduct" in (plan := best._jdf.queryExecution().toString()) or "BroadcastNestedLoopJoin" in plan


def test_answers_go_on_over_batches(spark):
    """Many answers in a task, cut anywhere by batches, are chosen as each alone."""
    rng = np.random.default_rng(3)
    rows = [(a, c, f"claim {c}", k, int(rng.integers(0, 4)), 0.5, 0.1, float(rng.random() + 0.3)) for a in range(30) for c in range(1, 6) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "answer_id long, claim_no int, claim string, cand_no int, idx long, ce_score double, keyword_sim double, combined double")
    whole = {(r.answer_id, r.claim_no): (r.cited, r.score, r.idx) for r in cite.cite(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert {(r.answer_id, r.claim_no): (r.cited, r.score, r.idx) for r in cite.cite(df).collect()} == whole
        assert len(whole) == 150
        one = df.where("answer_id = 17")
        assert {(r.answer_id, r.claim_no): (r.cited, r.score, r.idx) for r in cite.cite(one).collect()} == {k: v for k, v in whole.items() if k[0] == 17}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in cite.cite(df)._jdf.queryExecution().toString()  # a group for each answer cost milliseconds


def test_queries_of_a_search_are_made_and_embedded_once(spark):
    made, embedded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        made.add(1)
        return text

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        embedded.add(len(texts))
        return pd.Series(list(plugins._Hasher().vectors(texts.tolist())), dtype=object)

    documents, frags, tables = S.demo_fragments(spark)
    g = engine.build(documents, frags.select("doc_id", "page"), frags, tables)
    g.embed = vectors
    asked = spark.createDataFrame([(1, 1, "how long does linseed paint last"), (1, 2, "what is not allowed")], "doc_id long, query_id long, text string")
    assert engine.search(g, asked.withColumn("text", said("text"))).results.count() > 0
    assert (made.value, embedded.value) == (2, 2)


def test_sentences_keep_the_dots_of_abbreviations(spark):
    texts = ["See i.e. The first, e.g. The second. MR. Smith saw Fig. 3 and no. Then it ended here. Xal. Begins a new one.", "one.i.e.e.g. And more of it here. prof.Dr. Who came late today.", " \n ", "short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", T.sentences(F.col("text")).alias("s")).collect()}
    assert got == {
        0: ["See i.e. The first, e.g. The second.", "MR. Smith saw Fig. 3 and no. Then it ended here.", "Begins a new one."],
        1: ["one.i.e.e.g. And more of it here. prof.Dr. Who came late today."],
        2: [], 3: ["short"], 4: [],
    }


def test_hash_embedding_by_token():
    import hashlib

    texts = ["a b a", None, "", "Über-cool x_1 " * 40]
    got = plugins._Hasher().vectors(texts)
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(plugins.DIMENSION)
        for token in plugins._TOKEN.findall((t or "").lower()):
            digest = hashlib.md5(token.encode()).digest()
            want[digest[0] % plugins.DIMENSION] += 1 if digest[1] % 2 else -1
        size = np.linalg.norm(want)
        assert np.allclose(v, want / size if size else want)


def test_files_and_streaming(spark, tmp_path):
    from docloom.streaming.ingest import ingest, stream_files

    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "one")):
        (tmp_path / "in" / name).write_text(text)
    files = S.scan_files(spark, str(tmp_path / "in"), "*.txt")
    assert files.select("content_hash").distinct().count() == 2
    lines, rejected = S.parse_files(files, lambda path, data: [(path, data.decode())] if data != b"two" else (_ for _ in ()).throw(ValueError("unreadable")), "path string, text string")
    assert lines.count() == 2
    assert [(r.path[-5:], r.error) for r in rejected.collect()] == [("b.txt", "ValueError: unreadable")]
    got = []
    for _ in range(2):
        q = ingest(stream_files(spark, str(tmp_path / "in"), "*.txt"), str(tmp_path / "seen"), lambda df: got.extend(r.content_hash for r in df.collect()), str(tmp_path / f"ck{len(got)}"))
        q.awaitTermination()
    assert len(got) == 2  # the second stream starts afresh, yet each content is handled once


def pdf_file(streams, title=b"Garden bridges", packed=False):
    """A small PDF with a page for each content stream, two simple fonts, a composite one and a form."""
    import zlib

    form = b"BT /F1 8 Tf 1 0 0 1 10 500 Tm (In form) Tj ET"
    cmap = b"1 beginbfchar <0001> <6F22> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    plain = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (20 + 2 * k) for k in range(len(streams))) + b"]/MediaBox[0 0 612 792]/Resources 3 0 R>>",
        3: b"<</Font<</F1 5 0 R/F2 6 0 R/F3 9 0 R>>/XObject<</X 8 0 R>>>>",
        5: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/Encoding/WinAnsiEncoding>>",
        6: b"<</Type/Font/Subtype/TrueType/BaseFont/Arial/FirstChar 32/Widths[278 " + b"556 " * 94 + b"]/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[126/eacute/seven]>>>>",
        7: b"<</Title(" + title + b")>>",
        9: b"<</Type/Font/Subtype/Type0/BaseFont/Song/DescendantFonts[10 0 R]/ToUnicode 11 0 R>>",
        10: b"<</Type/Font/DW 1000/W[2[600 700]]>>",
    }
    parts = {8: (b"/Subtype/Form", form), 11: (b"", cmap)}
    for k, content in enumerate(streams):
        plain[20 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (21 + 2 * k)
        parts[21 + 2 * k] = (b"/Filter/FlateDecode", zlib.compress(content))
    out = b"%PDF-1.5\n"
    if packed:
        heads, body = b"", b""
        for k, v in plain.items():
            heads += b"%d %d " % (k, len(body))
            body += v + b" "
        parts[40] = (b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(plain), len(heads)), zlib.compress(heads + body))
        plain = {}
    out += b"".join(b"%d 0 obj\n%b\nendobj\n" % x for x in plain.items())
    out += b"".join(b"%d 0 obj\n<<%b/Length %d>>stream\n%b\nendstream\nendobj\n" % (k, info, len(raw), raw) for k, (info, raw) in parts.items())
    return out + b"trailer<</Root 1 0 R/Info 7 0 R>>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_words(packed):
    from docloom.sources import pdf

    page = b"BT /F1 16 Tf 72 720 Td (Bridge \\(old\\)) Tj /F2 10 Tf 0 -24 Td [(Oak pl) -20 (~nks ca) 400 (rry) -900 (\\060\177)] TJ 14 TL T* (two w\\141lkers.) Tj ET q 1 0 0 1 100 0 cm /X Do Q"
    rows = pdf.words("x", pdf_file([page, b"BT /F3 9 Tf 1 0 0 1 50 700 Tm <000100020003> Tj ET"], packed=packed))
    assert [(r[0], r[1], r[2], r[7]) for r in rows] == [
        (1, 0, "Bridge", "Helvetica-Bold"), (1, 1, "(old)", "Helvetica-Bold"), (1, 2, "Oak", "Arial"), (1, 3, "plénks", "Arial"), (1, 4, "ca", "Arial"), (1, 5, "rry", "Arial"), (1, 6, "07", "Arial"),
        (1, 7, "two", "Arial"), (1, 8, "walkers.", "Arial"), (1, 9, "In", "Helvetica-Bold"), (1, 10, "form", "Helvetica-Bold"), (2, 0, "漢ab", "Song"),
    ]
    first, oak, form = rows[0], rows[2], rows[9]
    assert first[3:7] == pytest.approx((72.0, 792 - 720 + 3.2 - 16, 792 - 720 + 3.2, 16.0)) and first[8:] == (612.0, 792.0, "Garden bridges")
    assert (oak[3], oak[6]) == (72.0, 10.0) and form[3] == 110.0
    for bad in (b"plain text", pdf_file([]), pdf_file([page]).replace(b"/Info 7", b"/Encrypt 7")):
        with pytest.raises(ValueError):
            pdf.words("x", bad)


def test_pdf_files_end_to_end(spark, tmp_path):
    from docloom.sources import pdf

    line = lambda y, text, font="F2", size=10: f"1 0 0 1 72 {y} Tm /{font} {size} Tf ({text}) Tj".encode()
    pages = [
        b"BT " + b" ".join([line(740, "Planks and Beams", "F1", 16), line(700, "Oak planks carry two walkers at once."), line(686, "Larch beams stay dry.")]) + b" ET",
        b"BT " + b" ".join([line(740, "Paint and Weather", "F1", 16), line(700, "Linseed paint resists frost for seven winters."), line(686, "Zinc screws keep their grip.")]) + b" ET",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bridges.pdf").write_bytes(pdf_file(pages))
    (tmp_path / "in" / "broken.pdf").write_bytes(b"nothing")
    documents, words, sizes, rejected = pdf.scan(spark, str(tmp_path / "in"))
    assert [r.path[-10:] for r in rejected.collect()] == ["broken.pdf"]
    assert sizes.count() == 2
    built = engine.from_words(documents, words)
    assert {r.type: r.n for r in graph.type_counts(built.nodes()).collect()} == {"PDF": 1, "Page": 2, "Section": 2, "Sentence": 4, "SemanticChunk": 2}
    assert built.documents.first().title == "Garden bridges"
    doc = built.documents.first().doc_id
    found = engine.search(built, spark.createDataFrame([(doc, 1, "how many winters does paint resist")], "doc_id long, query_id long, text string")).results
    assert found.orderBy("rank").first().section == "Paint and Weather"


def test_pages_without_sentences_fall_back(spark):
    found = spark.createDataFrame([(1, "a", 7), (1, "b", 2), (1, "c", None)], "doc_id long, node_id string, page int")
    pages = spark.createDataFrame([(1, "b", 3, 4, 0)], "doc_id long, node_id string, page int, n long, first_idx int")
    got = {(r.node_id, r.page, r.n) for r in retrieve.with_fallback_page(found, pages).collect()}
    assert got == {("a", 7, 1), ("b", 3, 4)}


def test_answer_text_highlights_and_drawing(spark):
    row = spark.createDataFrame([(1, 2, "why", "m", "extractive", [2, 3], 3, 4, 0.75, "So it is.")], "doc_id long, query_id long, query string, model_name string, backend string, source_pages array<int>, n_cited int, total_claims int, cite_rate double, answer string")
    text = render.answer_text(row).first()["text"]
    assert 'Query     : "why"' in text and "3/4 claims (75%)" in text and "[2, 3]" in text and text.endswith("So it is.\n")
    results = spark.createDataFrame([(1, 1, 5, 1, [("a",)]), (1, 1, 5, 2, [("b",), ("c",), ("d",), ("e",)])], "doc_id long, query_id long, page int, rank int, sentences array<struct<text:string>>")
    assert render.page_highlights(results).first()["sentences"] == ["b", "c", "d"]
    edges = spark.createDataFrame([(d, "a", str(k), "R") for d in (1, 2) for k in range(9)], "doc_id long, src string, dst string, relation string")
    assert {(r.doc_id, r["count"]) for r in render.cap_edges(edges, 4).groupBy("doc_id").count().collect()} == {(1, 4), (2, 4)}


def test_web_lines(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>Top &amp; all</h1><p>Body <b>text</b>.</p>"), (2, "u", None)], "page_id long, url string, html string")
    assert [(r.text, r.size) for r in plugins.html_lines(pages).orderBy("line_no").collect()] == [("Top & all", 16.0), ("Body text.", 10.0)]


def test_rounding_and_similarity_as_in_sql(spark):
    import duckdb

    values = [0.5015, -0.5015, 0.0015, 1.0005, 0.12345, -0.00003, -1e-18, -0.0, 0.0, 0.0005, 2.5, None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double")
    for digits in (3, 4):
        got = [r.x for r in rows.select("k", V.rounded(F.col("x"), digits).alias("x")).orderBy("k").collect()]
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?::INT)", [x, digits]).fetchone()[0] for x in values]
        assert list(map(repr, got)) == list(map(repr, want))
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(size=(300, 64)), 9).tolist()
    b = (rng.integers(-3, 4, (300, 64)) / 7).astype(np.float32).tolist()
    pairs = spark.createDataFrame([(k, *p) for k, p in enumerate([*zip(a, b, strict=True), ([0.0] * 64, b[0]), (None, b[0])])], "k int, a array<double>, b array<float>")
    got = [r.x for r in pairs.select("k", V.fused_cosine("a", "b").alias("x")).orderBy("k").collect()]
    want = [duckdb.execute("SELECT list_cosine_similarity(?::DOUBLE[], ?::FLOAT[]::DOUBLE[])", [x, y]).fetchone()[0] for x, y in zip(a, b, strict=True)]
    assert got == [*want, 0.0, None]
