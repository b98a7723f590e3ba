"""The registered queries as SQL for DuckDB over the same tables. Shared parts are CTEs, put together by ``_sql``."""

from __future__ import annotations

from . import constants as C

_W = r"[\p{L}\p{N}_]"
_TOKEN = rf"{_W}+(?:-{_W}+)*"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({x}, '({_W})-\s+({_W})', '\1\2', 'g'), '\s+', ' ', 'g')")


def _mask(x: str) -> str:
    """Dots of abbreviations become U+0001; the character before is part of the match, so each pass runs twice."""
    one = "|".join(a for a in C.ABBREVIATIONS if "." not in a)
    for a in (a for a in C.ABBREVIATIONS if "." in a):
        p, q = a.split(".")
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])({p})[.]({q})[.]', '\1\2' || chr(1) || '\3' || chr(1), 'gi')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])({one})[.]', '\1\2' || chr(1), 'gi')"
    return x


def _split(x: str) -> str:
    """Parts between sentence ends; U+0002 marks the borders."""
    return rf"""string_split(regexp_replace({x}, '([.!?])\s+([A-Z"(\[])', '\1' || chr(2) || '\2', 'g'), chr(2))"""


def _sentences(x: str) -> str:
    parts = f"list_transform({_split(_mask(x))}, lambda p: {_strip('replace(p, chr(1), chr(46))')})"
    found = f"list_filter({parts}, lambda p: length(p) > {C.SENTENCE_MORE_THAN})"
    return f"CASE WHEN len({found}) > 0 THEN {found} WHEN length({_strip(x)}) > 0 THEN [{_strip(x)}] ELSE [] END"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{_TOKEN}')"


def _keywords(x: str) -> str:
    return f"list_filter(list_distinct({_tokens(x)}), lambda t: length(t) > 1 AND NOT list_contains({_list(C.KEYWORD_STOPWORDS)}, t))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


_LEVEL = r"""CASE WHEN length(replace(text, ' ', '')) <= 2 OR regexp_full_match(replace(text, ' ', ''), '\p{Nd}+') THEN NULL
 WHEN size >= 10.0 + 4 OR (size >= 10.0 + 2 AND bold) THEN 1 WHEN size >= 10.0 + 1.5 AND (bold OR upper) THEN 2
 WHEN bold AND upper AND size >= 10.0 - 0.5 THEN 3 END"""

def _embedded(rows: str, name: str = "embedded") -> str:
    """(id, vec) of rows (id, text): signed feature hashing of tokens, of length one."""
    return f"""{name}_t AS (SELECT id, unnest({_tokens('text')}) AS term FROM ({rows})),
{name}_s AS (SELECT id, bucket, sum(sign) AS v FROM (SELECT id, ('0x' || md5(term)[1:2])::INT % 64 AS bucket, CASE WHEN ('0x' || md5(term)[3:4])::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END AS sign FROM {name}_t) GROUP BY ALL),
{name} AS (
 SELECT g.id, list((coalesce(v, 0) / CASE WHEN n > 0 THEN n ELSE 1 END)::FLOAT::DOUBLE ORDER BY b) AS vec
 FROM (SELECT id, b FROM ({rows}), range(64) AS r(b)) g LEFT JOIN {name}_s s ON s.id = g.id AND s.bucket = g.b
 LEFT JOIN (SELECT id, sqrt(sum(v * v)) AS n FROM {name}_s GROUP BY id) q ON q.id = g.id GROUP BY g.id)"""


PARTS = {
    "lines": r"""lines AS (
 SELECT doc_id, (n // 40 + 1)::INT AS page, n AS line_no, t AS text,
  CASE WHEN length(t) % 11 = 0 THEN 16.0 WHEN length(t) % 7 = 0 THEN 12.0 ELSE 10.0 END::DOUBLE AS size, length(t) % 2 = 0 AS bold,
  upper(t) = t AND regexp_matches(t, '\p{L}') AS upper, ((n % 40) * 14)::DOUBLE AS y_top, ((n % 40) * 14 + 10)::DOUBLE AS y_bot
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents))""",
    "words": """words AS (
 SELECT doc_id, page, k AS word_id, w AS text,
  (CASE WHEN doc_id % 2 = 0 THEN 40 + k * 37 % 530 WHEN k % 2 = 0 THEN 40 + k * 37 % 230 ELSE 340 + k * 37 % 230 END)::DOUBLE AS x0,
  y_top AS top, y_bot AS bottom, size, bold
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, pos) - 1 AS k
  FROM (SELECT *, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM lines) WHERE w <> ''))""",
    "hist": """hist AS (
 SELECT p.doc_id, p.page, b.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id, page FROM words) p CROSS JOIN (SELECT unnest(range(0, 30)) AS bucket) b
 LEFT JOIN (SELECT doc_id, page, least(floor(x0 / (612.0 / 30))::INT, 29) AS bucket, count(*) AS n FROM words GROUP BY ALL) c
  ON c.doc_id = p.doc_id AND c.page = p.page AND c.bucket = b.bucket)""",
    "cols": """cols AS (
 SELECT doc_id, page, CASE WHEN bool_or(bucket BETWEEN 2 AND 27 AND n <= 1 AND l >= 6 AND r >= 6) AND sum(n) >= 20 THEN 2 ELSE 1 END AS n_cols
 FROM (SELECT *, sum(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l, sum(n) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r
  FROM hist WINDOW w AS (PARTITION BY doc_id, page ORDER BY bucket)) GROUP BY doc_id, page)""",
    "assembled": r"""placed AS (
 SELECT w.*, (n_cols = 2 AND x0 >= 306)::INT AS col, round_even(top / 2, 0) * 2 AS row_ FROM words w JOIN cols USING (doc_id, page)),
numbered AS (
 SELECT *, sum(jump) OVER (PARTITION BY doc_id, page, col ORDER BY row_, x0, word_id ROWS UNBOUNDED PRECEDING) AS line
 FROM (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY doc_id, page, col ORDER BY row_, x0, word_id)) > 4 THEN 1 ELSE 0 END AS jump FROM placed)),
assembled AS (
 SELECT doc_id, page, col, text, size, bold, y_top, y_bot, (row_number() OVER (PARTITION BY doc_id, page, col ORDER BY line) - 1)::INT AS line_no,
  upper(text) = text AND regexp_matches(text, '\p{L}') AS upper
 FROM (SELECT doc_id, page, col, line, string_agg(text, ' ' ORDER BY row_, x0, word_id) AS text, avg(size) AS size, bool_or(bold) AS bold, min(top) AS y_top, max(bottom) AS y_bot
  FROM numbered GROUP BY doc_id, page, col, line) WHERE length(text) > 0)""",
    "boxes": "boxes AS (SELECT DISTINCT doc_id, page, 0 AS t_idx, 140.0 AS y0, 196.0 AS y1 FROM lines WHERE (doc_id + page) % 5 = 0)",
    "levelled": f"""levelled AS (
 SELECT *, {_LEVEL} AS level, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS seq
 FROM (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 AND line_no = 20 THEN 'References' ELSE text END AS text, CASE WHEN doc_id % 10 = 0 AND line_no = 20 THEN 16.0 ELSE size END AS size) FROM lines))""",
    "guarded": rf"""guarded AS (
 SELECT * FROM (SELECT *, max(CASE WHEN level IS NOT NULL AND regexp_full_match(text, '\s*({"|".join(C.REFERENCE_HEADINGS)})\s*', 'i') THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ref FROM levelled) WHERE level IS NOT NULL OR ref = 0)""",
    "frags": f"""joined AS (
 SELECT doc_id, page, frag_seq, coalesce(heading, '') AS heading, coalesce(lev, 1) AS level, {_clean("string_agg(text, ' ' ORDER BY seq)")} AS text
 FROM (SELECT *, sum((level IS NOT NULL)::INT) OVER w AS frag_seq, last_value(CASE WHEN level IS NOT NULL THEN text END IGNORE NULLS) OVER w AS heading, last_value(level IGNORE NULLS) OVER w AS lev
  FROM guarded WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE level IS NULL GROUP BY doc_id, page, frag_seq, heading, lev),
frags AS (SELECT * FROM (SELECT doc_id, page, frag_seq, heading, level, {_sentences('text')} AS sentences FROM joined) WHERE len(sentences) > 0)""",
    "merged": """merged AS (
 SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page, frag_seq ROWS UNBOUNDED PRECEDING)::INT AS section_no
 FROM (SELECT *, CASE WHEN lag(heading) OVER w IS NOT DISTINCT FROM heading AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
  FROM frags WINDOW w AS (PARTITION BY doc_id ORDER BY page, frag_seq)))""",
    "secs": """firsts AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id, section_no ORDER BY page, frag_seq) = 1),
secs AS (
 SELECT doc_id, section_no, 'section::' || section_no AS section_id, heading, level, page AS start_page,
  (SELECT max(b.section_no) FROM firsts b WHERE b.doc_id = a.doc_id AND b.section_no < a.section_no AND b.level < a.level) AS parent_no FROM firsts a)""",
    "sents": """sents AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, frag_seq, pos) AS idx
 FROM (SELECT doc_id, page, frag_seq, section_no, unnest(sentences) AS text, generate_subscripts(sentences, 1) AS pos FROM merged))""",
    "pages_": "pages_ AS (SELECT DISTINCT doc_id, page FROM lines)",
    "active": """active AS (
 SELECT doc_id, page, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS section_no
 FROM pages_ LEFT JOIN (SELECT doc_id, page, max(section_no) AS own FROM merged GROUP BY ALL) USING (doc_id, page))""",
    "fchunks": """fchunks AS (
 SELECT *, 'chunk::' || row_number() OVER (PARTITION BY doc_id ORDER BY page, frag_seq) AS chunk_id FROM merged)""",
    "chunked": """cdist AS (
 SELECT s.doc_id, s.section_no, s.idx, round(1 - cos, 9) AS d FROM (
  SELECT s.doc_id, s.section_no, s.idx, coalesce(nullif(list_cosine_similarity(e.vec, lag(e.vec) OVER (PARTITION BY s.doc_id, s.section_no ORDER BY s.idx)), 'NaN'::DOUBLE), 0) AS cos,
   row_number() OVER (PARTITION BY s.doc_id, s.section_no ORDER BY s.idx) AS n FROM sents s JOIN embedded e ON e.id = (s.doc_id, s.idx)) s WHERE n > 1),
cborder AS (SELECT *, round(avg(d) OVER p + 1.5 * stddev_pop(d) OVER p, 9) AS lim, count(*) OVER p AS m FROM cdist WINDOW p AS (PARTITION BY doc_id, section_no)),
craw AS (
 SELECT s.doc_id, s.section_no, s.idx, s.page, sum(CASE WHEN m > 1 AND d > lim THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id, s.section_no ORDER BY s.idx ROWS UNBOUNDED PRECEDING) AS raw
 FROM sents s LEFT JOIN cborder USING (doc_id, section_no, idx)),
cslot AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, section_no, raw ORDER BY idx) - 1) // 8 AS slot FROM craw),
chunked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY section_no, raw, slot) AS chunk_no FROM cslot)""",
    "edges": """edges AS (
 SELECT doc_id, 'pdf' AS src, 'page::' || page AS dst, 'HAS_PAGE' AS relation FROM pages_
 UNION ALL SELECT doc_id, 'page::' || page, 'page::' || nxt, 'NEXT_PAGE' FROM plinks UNION ALL SELECT doc_id, 'page::' || nxt, 'page::' || page, 'PREV_PAGE' FROM plinks
 UNION ALL SELECT doc_id, section_id, 'page::' || start_page, 'STARTS_ON' FROM secs
 UNION ALL SELECT doc_id, section_id, 'section::' || parent_no, 'PARENT_SECTION' FROM secs WHERE parent_no IS NOT NULL
 UNION ALL SELECT doc_id, 'section::' || parent_no, section_id, 'HAS_SUBSECTION' FROM secs WHERE parent_no IS NOT NULL
 UNION ALL SELECT doc_id, 'sentence::' || idx, 'page::' || page, 'ON_PAGE' FROM sents
 UNION ALL SELECT doc_id, 'sentence::' || idx, 'sentence::' || nxt, 'NEXT_SENTENCE' FROM slinks UNION ALL SELECT doc_id, 'sentence::' || nxt, 'sentence::' || idx, 'PREV_SENTENCE' FROM slinks
 UNION ALL SELECT doc_id, 'table::' || page || '::0', 'page::' || page, 'ON_PAGE' FROM boxes
 UNION ALL SELECT doc_id, 'table::' || page || '::0', 'section::' || section_no, 'IN_SECTION' FROM boxes JOIN active USING (doc_id, page) WHERE section_no IS NOT NULL
 UNION ALL SELECT DISTINCT doc_id, 'chunk::' || chunk_no, 'section::' || section_no, 'IN_SECTION' FROM chunked
 UNION ALL SELECT doc_id, 'sentence::' || idx, 'chunk::' || chunk_no, 'PART_OF_CHUNK' FROM chunked)""",
    "links": """plinks AS (SELECT * FROM (SELECT doc_id, page, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS nxt FROM pages_) WHERE nxt IS NOT NULL),
slinks AS (SELECT * FROM (SELECT doc_id, idx, lead(idx) OVER (PARTITION BY doc_id, section_no ORDER BY idx) AS nxt FROM sents) WHERE nxt IS NOT NULL)""",
    "docs": "entries AS (SELECT doc_id AS idx, text FROM documents)",
    "bm25": f"""tok AS (SELECT idx, {_tokens('text')} AS t FROM entries),
post AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest(t) AS term FROM tok) GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
idf0 AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM post, corpus GROUP BY term),
terms AS (SELECT term, df, CASE WHEN v < 0 THEN {C.BM25_EPSILON} * (SELECT avg(v) FROM idf0) ELSE v END AS idf FROM idf0)""",
    "scores": f"""scores AS (
 SELECT query_id, idx, round(sum(qtf * idf * tf * ({C.BM25_K1} + 1) / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * len(t) / avgdl))), 9) AS score
 FROM qterms JOIN terms USING (term) JOIN post USING (term) JOIN tok USING (idx), corpus GROUP BY query_id, idx),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scores) WHERE score >= best * {C.BM25_FLOOR})""",
    "asked": f"qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL)",
    "dense": """vq AS (SELECT vec_id AS query_id, embedding AS q, label FROM embeddings WHERE vec_id % 50 = 0),
dense AS (
 SELECT query_id, vec_id AS idx, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 9) AS sim FROM vq, embeddings),
dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, idx) AS rank FROM dense)""",
    "fused": """rankings AS (
 SELECT query_id, idx, 0 AS k, rank, 0.6 AS w FROM dranked WHERE rank <= 30
 UNION ALL SELECT * FROM (SELECT query_id, vec_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS r, 0.4 FROM vq JOIN embeddings e ON e.label = vq.label) WHERE r <= 30),
fused AS (
 SELECT query_id, idx, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, k, rank, idx) AS cand_rank
 FROM (SELECT query_id, idx, round(sum(w / (60 + rank)), 12) AS rrf_score, min(k) AS k, arg_min(rank, k) AS rank FROM rankings GROUP BY ALL))""",
    "cut": """cut AS (SELECT doc_id, line_no AS idx, line_no // 8 AS chunk_no, line_no // 12 + 1 AS page, text FROM lines WHERE length(text) > 0),
npages AS (SELECT doc_id, 'chunk::' || chunk_no AS node_id, chunk_no, page, count(*) AS n, min(idx) AS first_idx FROM cut GROUP BY ALL),
fracs AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, node_id) AS fraction FROM npages)""",
    "votes": f"""voted AS (
 SELECT doc_id, 1 AS query_id, page, round(sum((1.0::DOUBLE / (chunk_no + 61) + CASE WHEN chunk_no % 10 / 10 >= {C.SECTION_SIMILARITY} THEN {C.VOTE_SECTION} ELSE 0 END
  + CASE WHEN chunk_no % 3 = 0 THEN {C.VOTE_TABLE} ELSE 0 END) * fraction), 12) AS score FROM fracs GROUP BY doc_id, page)""",
    "cchunks": """cchunks AS (
 SELECT doc_id, chunk_no, string_agg(text, ' ' ORDER BY idx) AS context, (SELECT arg_min(text, idx) FROM cut b WHERE b.doc_id = a.doc_id) AS query FROM cut a GROUP BY doc_id, chunk_no)""",
    "turns": f"""turns AS (
 SELECT conv_id, turn, {_jaccard(_keywords('text'), _keywords('before'))} AS jaccard
 FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)""",
}

_SECTION = ("lines", "levelled", "guarded", "frags", "merged")
_GRAPH = (*_SECTION, "secs", "sents", _embedded("SELECT (doc_id, idx) AS id, text FROM sents"), "chunked", "pages_", "active", "boxes", "links", "edges")


def _sql(parts, select: str, recursive: bool = False) -> str:
    return "WITH RECURSIVE " * recursive + "WITH " * (not recursive) + ",\n".join(PARTS.get(p, p) for p in parts) + "\n" + select


def _negation(x: str) -> str:
    """Word borders as RE2 has them; the triggers are ASCII, and a letter beyond ASCII next to them is looked for by hand."""
    parts = []
    for t in C.NEGATION_TRIGGERS:
        core = t.removeprefix(r"\b").removesuffix(r"\b")
        end = rf"($|[^\p{{L}}\p{{N}}_])" if t.endswith(r"\b") else ""
        parts.append(rf"(^|[^\p{{L}}\p{{N}}_]){core}{end}")
    return f"regexp_matches({x}, '" + "|".join(parts).replace("'", "''") + "', 'i')"


_MARKERS = " ".join(C.NEGATION_MARKERS)
_CLAIM_TAIL = rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(C.CLAIM_ABBREVIATIONS)})[.]?\s*$"



def _claims(text: str) -> str:
    """(answer_id, claim_no, claim) of the assistant's turns."""
    return rf"""ca AS (SELECT conv_id || '-' || turn AS answer_id, {_split(_strip(text))} AS p FROM conversations WHERE role = 'assistant'),
cu AS (SELECT answer_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM ca),
cm AS (SELECT *, sum(CASE WHEN i > 1 AND regexp_matches(prev, '{_CLAIM_TAIL}', 'i') AND regexp_matches(part, '^[\p{{Lu}}\p{{Nd}}]') THEN 0 ELSE 1 END) OVER (PARTITION BY answer_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, lag(part) OVER (PARTITION BY answer_id ORDER BY i) AS prev FROM cu)),
claims AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY g) AS claim_no, claim FROM (SELECT answer_id, g, {_strip("string_agg(part, ' ' ORDER BY i)")} AS claim FROM cm GROUP BY ALL) WHERE length(claim) > 0)"""


def _cosine(a: str, b: str) -> str:
    return f"coalesce(nullif(list_cosine_similarity({a}, {b}), 'NaN'::DOUBLE), 0)"


#: A search of each document for its first sentence, up to the pages found.
_SEARCH = (
    f"""caps AS (SELECT b.doc_id, b.page, b.t_idx, coalesce(string_agg({_strip('text')}, ' ' ORDER BY line_no), '') AS caption FROM boxes b LEFT JOIN (
 SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.page ORDER BY line_no DESC) AS r FROM lines l JOIN boxes USING (doc_id, page)
 WHERE (y_top + y_bot) / 2 BETWEEN 60 AND 140 AND length({_strip('text')}) > 0) l ON l.doc_id = b.doc_id AND l.page = b.page AND r <= 3 GROUP BY ALL)""",
    """facts AS (
 SELECT doc_id, 'table::' || page || '::' || t_idx AS node_id, 'Table' AS type, trim(caption) AS text, section_no, 0 AS kind, page AS place FROM caps LEFT JOIN active USING (doc_id, page)
 UNION ALL SELECT doc_id, 'chunk::' || chunk_no, 'SemanticChunk', string_agg(s.text, ' ' ORDER BY idx), c.section_no, 1, chunk_no FROM chunked c JOIN sents s USING (doc_id, idx) GROUP BY doc_id, chunk_no, c.section_no)""",
    "ent AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, place) - 1 AS idx FROM facts)",
    f"q AS (SELECT doc_id, ({_sentences('text')})[1] AS text FROM documents WHERE len({_sentences('text')}) > 0)",
    _embedded("SELECT (doc_id, idx) AS id, text FROM ent", "evec"),
    _embedded("SELECT doc_id AS id, text FROM q", "qvec"),
    _embedded("SELECT (doc_id, section_no) AS id, heading AS text FROM secs", "hvec"),
    """mean AS (SELECT doc_id, list(m ORDER BY b) AS mean FROM (SELECT doc_id, b, avg(x) AS m FROM (SELECT doc_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS b FROM evec JOIN ent e ON id = (e.doc_id, e.idx)) GROUP BY ALL) GROUP BY doc_id)""",
    """ecen AS MATERIALIZED (SELECT e.doc_id, e.idx, list_transform(list_zip(vec, mean), lambda z: round(z[1] - z[2], 9)) AS c FROM evec JOIN ent e ON id = (e.doc_id, e.idx) JOIN mean USING (doc_id))""",
    """qcen AS MATERIALIZED (SELECT q.doc_id, q.text, vec, list_transform(list_zip(vec, mean), lambda z: round(z[1] - z[2], 9)) AS c FROM q JOIN qvec ON id = q.doc_id JOIN mean USING (doc_id))""",
    f"""dns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, idx) AS rank FROM (SELECT doc_id, e.idx, round({_cosine('q.c', 'e.c')}, 9) AS sim FROM qcen q JOIN ecen e USING (doc_id)))""",
    f"""btok AS (SELECT doc_id, idx, {_tokens('text')} AS t FROM ent),
bpost AS MATERIALIZED (SELECT doc_id, idx, term, count(*) AS tf FROM (SELECT doc_id, idx, unnest(t) AS term FROM btok) GROUP BY ALL),
bcor AS (SELECT doc_id, count(*) AS n_docs, avg(len(t)) AS avgdl FROM btok GROUP BY doc_id),
bidf AS (SELECT doc_id, term, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM bpost JOIN bcor USING (doc_id) GROUP BY doc_id, term),
bterm AS (SELECT doc_id, term, CASE WHEN v < 0 THEN {C.BM25_EPSILON} * avg(v) OVER (PARTITION BY doc_id) ELSE v END AS idf FROM bidf)""",
    f"""qterm AS (SELECT doc_id, kind, term, count(*) AS qtf FROM (
 SELECT doc_id, 1 AS kind, unnest({_tokens('text')}) AS term FROM q UNION ALL SELECT doc_id, 2, unnest({_tokens("'" + _MARKERS + "'")}) FROM q WHERE {_negation('text')}) GROUP BY ALL),
bsum AS (SELECT doc_id, kind, idx, round(sum(qtf * idf * tf * ({C.BM25_K1} + 1) / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * len(t) / avgdl))), 9) AS score
 FROM qterm JOIN bterm USING (doc_id, term) JOIN bpost USING (doc_id, term) JOIN btok USING (doc_id, idx) JOIN bcor USING (doc_id) GROUP BY ALL),
ball AS (SELECT d.doc_id, k.kind, d.idx, coalesce(score, 0) AS score FROM dns d JOIN (SELECT doc_id, 1 AS kind FROM q UNION ALL SELECT DISTINCT doc_id, kind FROM qterm WHERE kind = 2) k ON k.doc_id = d.doc_id
 LEFT JOIN bsum b ON b.doc_id = d.doc_id AND b.kind = k.kind AND b.idx = d.idx),
brank AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY score DESC, idx) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, kind) AS best FROM ball) WHERE score >= best * {C.BM25_FLOOR})""",
    f"""seen AS (SELECT doc_id, idx, 0 AS k, rank, {C.DENSE_WEIGHT} AS w FROM dns UNION ALL SELECT doc_id, idx, kind, rank, CASE kind WHEN 1 THEN {C.BM25_WEIGHT} ELSE {C.NEGATION_WEIGHT} END FROM brank),
fusion AS (SELECT doc_id, idx, rrf, row_number() OVER (PARTITION BY doc_id ORDER BY rrf DESC, k, rank, idx) AS cand_rank
 FROM (SELECT doc_id, idx, round(sum(w::DOUBLE / ({C.RRF_K} + rank)), 12) AS rrf, min(k) AS k, arg_min(rank, k) AS rank FROM seen GROUP BY doc_id, idx) QUALIFY cand_rank <= {C.CANDIDATES})""",
    f"""first_cap AS (SELECT doc_id, section_no, arg_min(caption, page * 1000 + t_idx) AS cap FROM caps JOIN active USING (doc_id, page) WHERE section_no IS NOT NULL GROUP BY ALL),
cands AS MATERIALIZED (SELECT f.doc_id, f.cand_rank, f.rrf, e.node_id, e.type, e.text, coalesce(s.heading, '') AS section, coalesce(cap, '') AS cap, q.text AS query,
  CASE WHEN h.vec IS NOT NULL THEN round({_cosine('q.vec', 'h.vec')}, 9) END AS section_sim, coalesce(CASE WHEN h.vec IS NOT NULL THEN round({_cosine('q.c', 'h.vec')}, 4) END, 0) AS section_score
 FROM fusion f JOIN ent e USING (doc_id, idx) JOIN qcen q USING (doc_id) LEFT JOIN secs s ON s.doc_id = e.doc_id AND s.section_no = e.section_no
 LEFT JOIN hvec h ON h.id = (e.doc_id, e.section_no) LEFT JOIN first_cap c ON c.doc_id = e.doc_id AND c.section_no = e.section_no)""",
    """npg AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, node_id) AS fraction FROM (
 SELECT doc_id, 'chunk::' || chunk_no AS node_id, page, count(*) AS n, min(idx) AS first_idx FROM chunked GROUP BY ALL UNION ALL SELECT doc_id, 'table::' || page || '::' || t_idx, page, 1, 0 FROM caps)),
prime AS (SELECT doc_id, node_id, page AS main FROM npg QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY n DESC, first_idx) = 1),
span AS (SELECT doc_id, node_id, min(page) AS low, max(page) AS high, string_agg('p' || page || ': ' || printf('%.0f', round(fraction * 100)) || '%', ', ' ORDER BY page) AS said FROM npg GROUP BY ALL)""",
    f"""pscore AS (SELECT doc_id, page, round(sum((rrf * {C.VOTE_CHUNK} + CASE WHEN section_sim >= {C.SECTION_SIMILARITY} THEN {C.VOTE_SECTION} ELSE 0 END + CASE WHEN length(cap) > 0 THEN {C.VOTE_TABLE} ELSE 0 END) * fraction), 12) AS score
 FROM cands JOIN npg USING (doc_id, node_id) GROUP BY doc_id, page),
ptop AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page) AS rank FROM pscore QUALIFY rank <= {C.TOP_K}),
pbest AS (SELECT doc_id, main AS page, arg_min(node_id, cand_rank) AS node_id FROM cands JOIN prime USING (doc_id, node_id) GROUP BY ALL)""",
    """block AS (SELECT t.doc_id, c.query, t.rank, concat_ws(chr(10), chr(10) || printf('  #%d  Score: %.4f  |  ', t.rank, round(t.score, 4)) || CASE WHEN low = high THEN 'Page ' || t.page ELSE 'Pages ' || low || '-' || high END || '  [' || type || ']',
  CASE WHEN length(section) > 0 THEN '       Section   : ' || section || printf('  (sim: %.3f)', round(section_score, 3)) END, CASE WHEN length(cap) > 0 THEN '       Table     : ' || cap END,
  CASE WHEN low < high THEN '       Pages     : ' || said END, '       Content   : ' || CASE WHEN length(c.text) > 200 THEN c.text[1:197] || '...' ELSE c.text END) AS b
 FROM ptop t JOIN pbest USING (doc_id, page) JOIN cands c USING (doc_id, node_id) JOIN span USING (doc_id, node_id))""",
)

#: One step of a walk takes the best candidate given those taken before.
_MMR = (
    """cand AS MATERIALIZED (SELECT query_id, idx, rank AS seq, sim, embedding::DOUBLE[] AS e FROM dranked JOIN embeddings ON vec_id = idx WHERE rank <= 30)""",
    """near AS MATERIALIZED (SELECT a.query_id, a.idx AS a, b.idx AS b, list_cosine_similarity(a.e, b.e) AS c FROM cand a JOIN cand b USING (query_id))""",
    f"""walk AS (SELECT query_id, 0 AS k, []::BIGINT[] AS taken, 0::BIGINT AS idx, 0::DOUBLE AS sim, 0::DOUBLE AS score FROM cand GROUP BY query_id
 UNION ALL SELECT query_id, k + 1, list_append(taken, idx), idx, sim, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS r FROM (
   SELECT w.query_id, w.k, w.taken, c.idx, c.seq, c.sim, {C.MMR_LAMBDA} * c.sim - coalesce({1 - C.MMR_LAMBDA} * max(n.c), 0) AS score
   FROM walk w JOIN cand c ON c.query_id = w.query_id AND NOT list_contains(w.taken, c.idx) LEFT JOIN near n ON n.query_id = c.query_id AND n.a = c.idx AND list_contains(w.taken, n.b)
   WHERE w.k < {C.MMR_BUDGET} GROUP BY w.query_id, w.k, w.taken, c.idx, c.seq, c.sim)) WHERE r = 1)""",
)
_CITED = (
    _claims("text"),
    _embedded("SELECT (answer_id, claim_no) AS id, claim AS text FROM claims", "cvec"),
    _embedded("SELECT doc_id AS id, text FROM documents", "dvec"),
    f"""best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, idx) AS cand_no FROM (
 SELECT c.id AS cid, d.id AS idx, round(coalesce(nullif(list_cosine_similarity(c.vec, d.vec), 'NaN'::DOUBLE), 0), 9) AS sim FROM cvec c, dvec d) QUALIFY cand_no <= {C.CITE_CANDIDATES})""",
    f"""kclaim AS (SELECT answer_id, claim_no, claim, {_keywords('claim')} AS ck FROM claims), kdoc AS (SELECT doc_id AS idx, {_keywords('text')} AS ek FROM documents)""",
    f"""cand AS MATERIALIZED (SELECT answer_id, claim_no, cand_no, idx, kw, ce, round(ce + kw * {C.KEYWORD_WEIGHT}, 9) AS combined FROM (
 SELECT *, 1 / (1 + exp(1 - 6 * kw)) AS ce FROM (SELECT answer_id, claim_no, cand_no, idx, {_jaccard('ck', 'ek')} AS kw FROM best JOIN kclaim k ON cid = (k.answer_id, k.claim_no) JOIN kdoc USING (idx))))""",
    f"""walk AS (SELECT answer_id, 0::BIGINT AS claim_no, []::BIGINT[] AS seen, 0::DOUBLE AS top, 0::BIGINT AS idx, 0::DOUBLE AS ce, 0::DOUBLE AS kw FROM claims GROUP BY answer_id
 UNION ALL SELECT answer_id, claim_no, CASE WHEN top >= {C.CITE_THRESHOLD} THEN list_append(seen, idx) ELSE seen END, top, idx, ce, kw FROM (
  SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY top DESC, cand_no) AS r FROM (
   SELECT answer_id, claim_no, seen, idx, ce, kw, cand_no, CASE WHEN m >= {C.HUB_LIMIT} THEN -1.0 ELSE combined / (1 + {C.DIVERSITY_ALPHA} * m) END AS top
   FROM (SELECT c.*, w.seen, len(list_filter(w.seen, lambda s: s = c.idx)) AS m FROM walk w JOIN cand c ON c.answer_id = w.answer_id AND c.claim_no = w.claim_no + 1)
  )) WHERE r = 1)""",
)

#: The entities that the pages hold, the ampersand last.
_ENTITIES = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"

ORACLE: dict[str, str] = {
    "clean_text": rf"SELECT doc_id, {_clean(r"regexp_replace(text, '((?:[^ ]* ){9}[^ ]*) ', '\1-' || chr(10), 'g')")} AS text FROM documents",
    "split_sentences": f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "highlight_terms": f"""SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda x: {{'p': list_position(t, x), 'x': x}}))[1:12], lambda e: e.x), ' ') AS terms
 FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_/-]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(C.HIGHLIGHT_STOPWORDS)}, w)) AS t FROM benchmark)""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
    "content_hash": "SELECT doc_id, sha256(text)[1:16] AS content_hash FROM documents",
    "hash_embedding": f"""WITH t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents),
s AS (SELECT doc_id, ('0x' || md5(term)[1:2])::INT % 64 AS bucket, sum(CASE WHEN ('0x' || md5(term)[3:4])::INT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM t GROUP BY ALL)
SELECT doc_id, bucket, round((v / n)::FLOAT::DOUBLE, 5) AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS n FROM s) WHERE v <> 0""",
    "column_histogram": _sql(("lines", "words", "hist"), "SELECT doc_id, page, bucket, n FROM hist"),
    "detect_columns": _sql(("lines", "words", "hist", "cols"), "SELECT * FROM cols"),
    "line_assembly": _sql(("lines", "words", "hist", "cols", "assembled"), "SELECT doc_id, page, col, line_no, text, round(size, 6) AS size, bold, upper, y_top, y_bot FROM assembled"),
    "modal_size": _sql(("lines", "words", "hist", "cols", "assembled"), """SELECT doc_id, page, col, s AS body_size
 FROM (SELECT doc_id, page, col, round(size, 1) AS s, count(*) AS n, min(line_no) AS seen FROM assembled GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page, col ORDER BY n DESC, seen) = 1"""),
    "heading_level": _sql(("lines", "levelled"), "SELECT doc_id, line_no, level FROM levelled WHERE level IS NOT NULL"),
    "table_area_mask": _sql(("lines", "boxes"), """SELECT doc_id, line_no, page FROM lines l
 WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = l.doc_id AND b.page = l.page AND (y_top + y_bot) / 2 BETWEEN y0 AND y1)"""),
    "caption_band": _sql(("lines", "boxes"), f"""SELECT b.doc_id, b.page, b.t_idx, coalesce(string_agg({_strip('text')}, ' ' ORDER BY line_no), '') AS caption FROM boxes b LEFT JOIN (
 SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.page ORDER BY line_no DESC) AS r FROM lines l JOIN boxes USING (doc_id, page)
 WHERE (y_top + y_bot) / 2 BETWEEN 60 AND 140 AND length({_strip('text')}) > 0) l ON l.doc_id = b.doc_id AND l.page = b.page AND r <= 3 GROUP BY ALL"""),
    "infer_title": _sql(("lines",), """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Title ' || doc_id ELSE coalesce(
 (SELECT text FROM lines l WHERE l.doc_id = d.doc_id AND page = 1 AND y_top < 792 * 0.4 ORDER BY size DESC, line_no LIMIT 1),
 (SELECT text FROM lines l WHERE l.doc_id = d.doc_id AND page = 1 ORDER BY size DESC, line_no LIMIT 1), '') END AS title FROM documents d"""),
    "reference_guard": _sql(("lines", "levelled", "guarded"), "SELECT doc_id, line_no FROM guarded"),
    "section_fragments": _sql(_SECTION[:4], "SELECT doc_id, page, frag_seq, heading, level, array_to_string(sentences, '|') AS sentences FROM frags"),
    "extracted_sections": _sql(("lines", "words", "hist", "cols", "assembled", "boxes", f"""bodies AS (SELECT doc_id, page, col, s AS body
 FROM (SELECT doc_id, page, col, round(size, 1) AS s, count(*) AS n, min(line_no) AS seen FROM assembled GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page, col ORDER BY n DESC, seen) = 1),
levelled AS (
 SELECT doc_id, page, text, {_LEVEL.replace("10.0", "body")} AS level, row_number() OVER (PARTITION BY doc_id ORDER BY page, col, line_no) AS seq
 FROM assembled a JOIN bodies USING (doc_id, page, col) WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = a.doc_id AND b.page = a.page AND (y_top + y_bot) / 2 BETWEEN y0 AND y1))""", "guarded", "frags"),
        "SELECT doc_id, page, frag_seq, heading, level, array_to_string(sentences, '|') AS sentences FROM frags"),
    "section_merge": _sql(_SECTION, "SELECT doc_id, page, frag_seq, section_no FROM merged"),
    "section_hierarchy": _sql((*_SECTION, "secs"), "SELECT * FROM secs"),
    "active_section": _sql((*_SECTION, "pages_", "active"), "SELECT * FROM active"),
    "page_links": _sql(("lines", "pages_"), """SELECT doc_id, 'page::' || a AS src, 'page::' || b AS dst, relation FROM (
 SELECT doc_id, page AS a, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS b, 'NEXT_PAGE' AS relation FROM pages_
 UNION ALL SELECT doc_id, page, lag(page) OVER (PARTITION BY doc_id ORDER BY page), 'PREV_PAGE' FROM pages_) WHERE b IS NOT NULL"""),
    "sentence_links": _sql((*_SECTION, "sents"), """SELECT doc_id, 'sentence::' || a AS src, 'sentence::' || b AS dst, relation FROM (
 SELECT doc_id, idx AS a, lead(idx) OVER (PARTITION BY doc_id, section_no ORDER BY idx) AS b, 'NEXT_SENTENCE' AS relation FROM sents
 UNION ALL SELECT doc_id, idx, lag(idx) OVER (PARTITION BY doc_id, section_no ORDER BY idx), 'PREV_SENTENCE' FROM sents) WHERE b IS NOT NULL"""),
    "semantic_chunks": """WITH d AS (SELECT label, vec_id AS idx, round(1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]), 9) AS d FROM embeddings),
b AS (SELECT *, count(*) OVER p > 2 AND d > round(avg(d) OVER p + 1.5 * stddev_pop(d) OVER p, 9) AS cut FROM d WINDOW p AS (PARTITION BY label)),
r AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY label ORDER BY idx ROWS UNBOUNDED PRECEDING) AS raw FROM b),
s AS (SELECT *, (row_number() OVER (PARTITION BY label, raw ORDER BY idx) - 1) // 8 AS slot FROM r)
SELECT label, idx, dense_rank() OVER (PARTITION BY label ORDER BY raw, slot) - 1 AS chunk_in_part FROM s""",
    "graph_type_counts": _sql(_GRAPH, """SELECT 'PDF' AS type, count(*) AS n FROM documents UNION ALL SELECT 'Page', count(*) FROM pages_ UNION ALL SELECT 'Section', count(*) FROM secs
 UNION ALL SELECT 'Sentence', count(*) FROM sents UNION ALL SELECT 'Table', count(*) FROM boxes
 UNION ALL SELECT 'SemanticChunk', count(*) FROM (SELECT DISTINCT doc_id, chunk_no FROM chunked)"""),
    "graph_relation_counts": _sql(_GRAPH, "SELECT relation, count(*) AS n FROM edges GROUP BY relation"),
    "induced_subgraph": _sql(_GRAPH, """, allnodes AS (
 SELECT doc_id, 'pdf' AS node, 0 AS k, 0 AS o FROM documents UNION ALL SELECT doc_id, 'page::' || page, 1, page FROM pages_ UNION ALL SELECT doc_id, section_id, 2, section_no FROM secs
 UNION ALL SELECT doc_id, 'sentence::' || idx, 3, idx FROM sents UNION ALL SELECT doc_id, 'table::' || page || '::0', 4, page * 10000 FROM boxes
 UNION ALL SELECT DISTINCT doc_id, 'chunk::' || chunk_no, 5, chunk_no FROM chunked),
few AS (SELECT doc_id, node FROM allnodes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, o) <= 12)
SELECT relation, count(*) AS n FROM edges e WHERE (doc_id, src) IN (SELECT (doc_id, node) FROM few) AND (doc_id, dst) IN (SELECT (doc_id, node) FROM few) GROUP BY relation"""),
    "term_stats": _sql(("docs", "bm25"), "SELECT term, df, round(idf, 6) AS idf FROM terms"),
    "bm25_topk": _sql(("docs", "bm25", "asked", "scores"), "SELECT query_id, idx, round(score, 4) AS score, rank FROM kept WHERE rank <= 10"),
    "bm25_threshold": _sql(("docs", "bm25", "asked", "scores"), "SELECT query_id, count(*) AS n_kept, round(min(score), 4) AS low FROM kept GROUP BY query_id"),
    "corpus_mean": "SELECT pos, round(avg(v), 9) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos",
    "dense_topk": _sql(("dense",), "SELECT query_id, idx, round(sim, 6) AS sim, rank FROM dranked WHERE rank <= 10"),
    "negation_detect": f"SELECT conv_id, turn, {_negation('text')} AS negated FROM conversations",
    "negation_rank": f"""WITH entries AS (SELECT doc_id AS idx, text || CASE WHEN doc_id % 9 = 0 THEN ' SHALL NOT restricted' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ' prohibited' ELSE '' END AS text FROM documents),
{PARTS['bm25']}, qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tokens(f"'{_MARKERS}'")}) AS term FROM benchmark) GROUP BY ALL), {PARTS['scores']}
SELECT query_id, idx, round(score, 4) AS score, rank FROM kept WHERE rank <= 20""",
    "rrf_fuse": _sql(("dense", "fused"), "SELECT query_id, idx, round(rrf_score, 9) AS rrf_score, cand_rank FROM fused"),
    "hybrid_topk": _sql(("dense", "fused"), "SELECT query_id, idx, round(rrf_score, 9) AS rrf_score, cand_rank FROM fused WHERE cand_rank <= 10"),
    "page_distribution": _sql(("lines", "cut"), "SELECT doc_id, node_id, page, n, round(fraction, 9) AS fraction FROM fracs"),
    "primary_page": _sql(("lines", "cut"), "SELECT doc_id, node_id, page AS primary_page FROM npages QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY n DESC, first_idx) = 1"),
    "page_range": _sql(("lines", "cut"), "SELECT doc_id, node_id, CASE WHEN min(page) = max(page) THEN min(page)::VARCHAR ELSE min(page) || '-' || max(page) END AS page_range FROM npages GROUP BY ALL"),
    "page_votes": _sql(("lines", "cut", "votes"), "SELECT doc_id, query_id, page, round(score, 9) AS score FROM voted"),
    "ce_page_max": _sql(("lines", "cut", "cchunks"), f"""SELECT doc_id, 1 AS query_id, page, round(max(fraction / (1 + exp(1 - 6 * {_jaccard(_keywords('query'), _keywords('context'))}))), 9) AS score
 FROM cchunks JOIN fracs USING (doc_id, chunk_no) GROUP BY doc_id, page"""),
    "result_assembly": _sql(("lines", "cut", "votes"), """, prim AS (SELECT doc_id, node_id, chunk_no, page FROM npages QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY n DESC, first_idx) = 1),
best AS (SELECT doc_id, page, arg_min(node_id, chunk_no) AS node_id FROM prim GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page) AS rank FROM voted QUALIFY rank <= 5),
found AS (SELECT doc_id, page, query_id, round(score, 4) AS score, rank, node_id FROM ranked JOIN best USING (doc_id, page))
SELECT *, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END, 4) AS normalized_score FROM found WINDOW w AS (PARTITION BY doc_id)"""),
    "context_block": _sql(("lines", "cut", "cchunks"), """SELECT doc_id, chunk_no, concat_ws(' ', CASE WHEN chunk_no % 2 = 0 AND length(query) > 0 THEN '[Section: ' || query || ']' END, CASE WHEN length(context) > 0 THEN context END,
 CASE WHEN chunk_no % 3 = 0 THEN '[Table: Table ' || chunk_no || ']' END) AS block FROM cchunks"""),
    "siblings": _sql((*_SECTION, "fchunks"), "SELECT a.doc_id, 1 AS query_id, a.chunk_id AS origin_id, b.chunk_id AS neighbour_id FROM fchunks a JOIN fchunks b ON a.doc_id = b.doc_id AND a.section_no = b.section_no AND a.chunk_id <> b.chunk_id"),
    "cousins": _sql((*_SECTION, "secs", "fchunks"), """SELECT a.doc_id, 1 AS query_id, a.chunk_id AS origin_id, b.chunk_id AS neighbour_id FROM fchunks a JOIN secs s ON s.doc_id = a.doc_id AND s.section_no = a.section_no
 JOIN secs t ON t.doc_id = s.doc_id AND t.parent_no = s.parent_no AND t.section_no <> s.section_no JOIN fchunks b ON b.doc_id = t.doc_id AND b.section_no = t.section_no"""),
    "neighbourhood": _sql((*_SECTION, "secs", "fchunks"), """SELECT a.doc_id, 1 AS query_id, a.chunk_id AS origin_id, b.chunk_id AS neighbour_id FROM fchunks a JOIN fchunks b ON a.doc_id = b.doc_id AND a.section_no = b.section_no AND a.chunk_id <> b.chunk_id
 UNION SELECT a.doc_id, 1, a.chunk_id, b.chunk_id FROM fchunks a JOIN secs s ON s.doc_id = a.doc_id AND s.section_no = a.section_no
 JOIN secs t ON t.doc_id = s.doc_id AND t.parent_no = s.parent_no AND t.section_no <> s.section_no JOIN fchunks b ON b.doc_id = t.doc_id AND b.section_no = t.section_no"""),
    "sentence_window": _sql(("lines", "cut", _embedded("SELECT (doc_id, idx) AS id, text FROM cut")), f""", p AS (
 SELECT a.doc_id, a.idx AS o, b.idx AS n, abs(a.idx - b.idx) AS far, b.idx > a.idx AS side, round(coalesce(nullif(list_cosine_similarity(x.vec, y.vec), 'NaN'::DOUBLE), 0), 9) >= {C.WINDOW_SIMILARITY} AS near
 FROM cut a JOIN cut b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx <> b.idx JOIN embedded x ON x.id = (a.doc_id, a.idx) JOIN embedded y ON y.id = (b.doc_id, b.idx))
SELECT doc_id, 1 AS query_id, 'chunk::' || o AS origin_id, 'chunk::' || n AS neighbour_id
FROM (SELECT *, bool_and(near) OVER (PARTITION BY doc_id, o, side ORDER BY far ROWS UNBOUNDED PRECEDING) AS ok FROM p) WHERE ok"""),
    "assemble_context": _sql(("lines", "cut", "cchunks"), f""", item AS (SELECT doc_id, chunk_no, CASE WHEN chunk_no % 3 = 0 THEN 'Alpha' WHEN chunk_no % 3 = 1 THEN 'General' ELSE 'Beta' END AS s, {_strip('context')} AS t FROM cchunks),
said AS (SELECT *, {_strip(f"(CASE WHEN length(t) > {C.CONTEXT_CHARS} THEN t[1:{C.CONTEXT_CHARS}] || '...' ELSE t END || CASE WHEN chunk_no % 4 > 0 THEN ' (p.' || chunk_no || ')' ELSE '' END)")} AS line FROM item),
grp AS (SELECT doc_id, min(chunk_no) AS o, '[' || s || ']' || chr(10) || string_agg(line, chr(10) ORDER BY chunk_no) AS b FROM said GROUP BY doc_id, s)
SELECT doc_id, {_strip("string_agg(b, chr(10) || chr(10) ORDER BY o)")} AS context FROM grp GROUP BY doc_id"""),
    "split_claims": _sql((_claims("text || ' See Fig. 3 of Dr. Who. And so on.'"),), "SELECT answer_id, claim_no, claim FROM claims"),
    "mmr_select": _sql(("dense", *_MMR), "SELECT query_id, k AS mmr_rank, 'v' || idx AS node_id, round(sim, 6) AS query_sim, round(score, 6) AS mmr_score FROM walk WHERE k > 0", recursive=True),
    "search_results": _sql((*_SECTION, "secs", "sents", _embedded("SELECT (doc_id, idx) AS id, text FROM sents"), "chunked", "pages_", "active", "boxes", *_SEARCH), f"""
SELECT doc_id, doc_id AS query_id, chr(10) || 'Query: "' || query || '"' || chr(10) || repeat('-', 60) || chr(10) || string_agg(b, chr(10) ORDER BY rank) || chr(10) AS text FROM block GROUP BY doc_id, query"""),
    "cite_claims": _sql(_CITED, f"""SELECT answer_id, claim_no, top >= {C.CITE_THRESHOLD} AS cited, printf('%.4f', top)::DOUBLE AS score, printf('%.4f', ce)::DOUBLE AS ce_score, printf('%.4f', kw)::DOUBLE AS keyword_sim,
 CASE WHEN top >= {C.CITE_THRESHOLD} THEN 'doc::' || idx END AS matched_node, CASE WHEN top >= {C.CITE_THRESHOLD} THEN '[p. 1]' END AS citation FROM walk WHERE claim_no > 0""", recursive=True),
    "cited_sources": _sql(_CITED, f"""SELECT answer_id, string_agg(claim || CASE WHEN top >= {C.CITE_THRESHOLD} THEN ' [p. 1]' ELSE '' END, ' ' ORDER BY claim_no) AS answer,
 CASE WHEN bool_or(top >= {C.CITE_THRESHOLD}) THEN '1' ELSE '' END AS source_pages FROM walk JOIN claims USING (answer_id, claim_no) GROUP BY answer_id""", recursive=True),
    "keyword_jaccard": _sql(("turns",), "SELECT conv_id, turn, round(jaccard, 9) AS jaccard FROM turns"),
    "citation_stats": _sql(("turns",), """SELECT conv_id, count(*) AS total_claims, count(*) FILTER (jaccard >= 0.02) AS n_cited, count(*) FILTER (jaccard < 0.02) AS uncited, round(count(*) FILTER (jaccard >= 0.02) / count(*), 4) AS cite_rate,
 round(avg(jaccard), 4) AS mean_score, round(min(jaccard), 4) AS min_score, round(max(jaccard), 4) AS max_score, round(avg(jaccard) FILTER (turn % 2 = 0), 4) AS mean_ce_score, round(avg(jaccard), 4) AS mean_keyword_sim FROM turns GROUP BY conv_id"""),
    "web_lines": rf"""WITH b AS (SELECT page_id AS doc_id, unnest(x) AS b, generate_subscripts(x, 1) - 1 AS line_no FROM (
 SELECT page_id, regexp_extract_all(html, '(?is){"|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p"))}') AS x FROM pages)),
t AS (SELECT doc_id, line_no, lower(regexp_extract(b, '^<([A-Za-z]+[1-6]?)', 1)) AS tag,
 trim(regexp_replace({_ENTITIES.format("regexp_replace(b, '<[^>]+>', '', 'g')")}, '\s+', ' ', 'g')) AS text FROM b),
s AS (SELECT doc_id, line_no, tag, CASE tag WHEN 'h1' THEN 16.0 WHEN 'h2' THEN 12.0 ELSE 10.0 END::DOUBLE AS size, CASE WHEN tag NOT IN ('h1', 'h2', 'p') THEN upper(text) ELSE text END AS text FROM t WHERE text <> '')
SELECT doc_id, 1 AS page, 0 AS col, line_no, text, size, tag <> 'p' AS bold, upper(text) = text AND regexp_matches(text, '\p{{L}}') AS upper, 14.0::DOUBLE * line_no AS y_top, 14.0::DOUBLE * line_no + 10 AS y_bot FROM s""",
    "event_window_totals": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
for _name in ("induced_subgraph", "result_assembly", "assemble_context"):
    ORACLE[_name] = ORACLE[_name].replace("\n, ", ",\n", 1)
