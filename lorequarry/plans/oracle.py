"""SQL that gives the registered queries' results independently, for DuckDB."""

from __future__ import annotations

from ..functions.text import MIME_TYPES

MD = "'# Doc ' || doc_id || chr(10) || chr(10) || '## Lang ' || lang || chr(10) || chr(10) || 'See [' || source || '](#' || source || '). #' || lang || ' #' || source || chr(10) || text"
HTML = r"regexp_replace(regexp_replace(html, '<[^>]*>?|>', '', 'g'), '\s+', ' ', 'g')"


def _chunks(of: str, id: str, content: str, m: int = 128, o: int = 16) -> str:
    """CTEs tok and chunk (id, idx, content, token_count) of a table."""
    step = m - o
    return rf"""
tok AS (SELECT {id} AS id, regexp_extract_all({content}, '\S+\s*') AS t FROM {of}),
num AS (SELECT id, t, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= {m} THEN 1 ELSE (len(t) - {o} + {step - 1}) // {step} END AS k FROM tok),
cut AS (SELECT id, t, unnest(range(k)) AS idx FROM num),
chunk AS (SELECT id, idx, regexp_replace(array_to_string(list_slice(t, idx * {step} + 1, idx * {step} + {m}), ''), '\s+$', '') AS content, least({m}, len(t) - idx * {step}) AS token_count FROM cut)"""


MENTIONS = rf"""
md AS (SELECT doc_id, {MD} AS md FROM documents),
f AS (
  SELECT doc_id, unnest(regexp_extract_all(md, '\[([^\]]+)\]\(([^)]+)\)', 1)) AS name, 'reference' AS kind, 0 AS p FROM md
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(md, '(?:^|\s)#([a-zA-Z][\w-]+)', 1)), 'tag', 1 FROM md
  UNION ALL SELECT doc_id, trim(unnest(list_filter(regexp_extract_all(md, '(?m)^#{{1,6}}\s+(.+)', 1), lambda h: octet_length(h::BLOB) > 2))), 'section', 2 FROM md)"""

EDGES = """
edge AS (
  SELECT DISTINCT lang AS src, source AS dst, 'has' AS relation FROM documents
  UNION ALL SELECT source, 'Doc ' || min(doc_id), 'first' FROM documents GROUP BY source
  UNION ALL SELECT 'Doc ' || doc_id, 'Doc ' || (doc_id + 1), 'next' FROM documents
  UNION ALL SELECT 'Doc ' || doc_id, lang, 'in' FROM documents)"""


def _bm25(queries: str, rows: str, id: str, content: str, all_terms: bool = True) -> str:
    """CTE kw (query_id, id, score) of CTE or subquery queries (query_id, term)."""
    matched = "HAVING count(*) = any_value(c.terms)" if all_terms else ""
    return rf"""
q AS (SELECT DISTINCT query_id, term FROM ({queries})),
qc AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id),
bag AS (SELECT {id} AS id, regexp_extract_all(lower({content}), '\p{{L}}+|\p{{N}}+') AS t FROM {rows}),
st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM bag),
tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM bag) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
kw AS (SELECT q.query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN qc c USING (query_id) CROSS JOIN st GROUP BY q.query_id, tf.id {matched})"""


DOT = "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * p[2]))"
NORM = "sqrt(list_sum(list_transform({0}.embedding::DOUBLE[], lambda x: x * x)))"
COSINE = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')})"
ITEMS = r"SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\p{L}+|\p{N}+')) AS term FROM benchmark"
PROBE = "SELECT 0 AS query_id, unnest(['ther', 'hein']) AS term"


def _hybrid(k: int) -> str:
    return f"""WITH j AS (SELECT d.doc_id, d.text, d.lang, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
{_bm25(PROBE, "j", "doc_id", "text")},
vs AS (SELECT a.doc_id AS id, round({COSINE}, 6) AS score FROM j a, embeddings b WHERE b.vec_id = 0),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= {3 * k}),
w AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= {3 * k}),
r AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY id),
h AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= {k})
"""


LETTERS = "list_transform(range(97, 123), lambda c: (length({0}) - length(replace({0}, chr(c::INT), '')))::DOUBLE)"
_LIKE = "list_cosine_similarity(a.e, b.e)"


def _letters(once: str, rows: str) -> str:
    """CTEs chunk, ce (id, e: letter counts) of CTE once, and qe (query_id, e) of rows (query_id, text)."""
    return f"""{once}, {_chunks("once", "sha256", "text")},
cl AS (SELECT id || '#' || idx AS id, lower(content) AS t, content FROM chunk), ce AS (SELECT id, content, {LETTERS.format("t")} AS e FROM cl),
ql AS (SELECT query_id, lower(text) AS t FROM ({rows})), qe AS (SELECT query_id, {LETTERS.format("t")} AS e FROM ql)"""


def _mime(name: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MIME_TYPES.items())
    return rf"CASE lower(regexp_extract(regexp_extract({name}, '([^/]*)/*$', 1), '^.+\.([^.]*)$', 1)) {cases} END"


def oracle_sql() -> dict[str, str]:
    _once = "once AS (SELECT sha256(text) AS sha256, any_value(text) AS text, arg_min(source, doc_id) AS source FROM documents GROUP BY sha256(text))"
    entity = f"SELECT name, count(*) AS n, min(doc_id) AS first_doc FROM f WHERE kind = '{{}}' GROUP BY name"
    clean = r"regexp_replace(name, '[⟨⟩\\'']', '', 'g')"
    found = {
        "dedup_sha256": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)",
        "html_to_text": f"SELECT page_id, {HTML} AS text FROM pages",
        "extract_by_source": rf"SELECT page_id, md5(CASE WHEN NOT regexp_matches(lower(url), '\.(md|markdown)$') AND NOT contains(url, 'markdown') AND regexp_matches(lower(url), '\.html?$') THEN {HTML} ELSE html END) AS text_md5 FROM pages",
        "mime_inference": f"""SELECT 'p' || page_id AS id, {_mime("url")} AS mime FROM pages UNION ALL
SELECT 'd' || doc_id, {_mime("s")} FROM (SELECT doc_id, source || (['/notes.MD', '/a.b/.hidden', '/x.yml', '/x.html?page=2', '/data.csv', '/lib.rs', '/plain'])[doc_id % 7 + 1] AS s FROM documents)""",
        "base64_roundtrip": "SELECT item_id, text FROM benchmark",
        "chunk_windows": f"WITH {_chunks('documents', 'doc_id', 'text')} SELECT id AS doc_id, idx, content, token_count FROM chunk",
        "chunk_counts": f"WITH {_chunks('documents', 'doc_id', 'text')} SELECT id AS doc_id, len(t) AS tokens, k AS chunks FROM num",
        "upload_summary": rf"""WITH m AS (SELECT doc_id, {MD} AS md FROM documents), {_chunks("m", "doc_id", "md")},
n AS (SELECT id, unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 1)) AS name FROM chunk
  UNION ALL SELECT id, unnest(regexp_extract_all(content, '(?:^|\s)#([a-zA-Z][\w-]+)', 1)) FROM chunk
  UNION ALL SELECT id, trim(unnest(list_filter(regexp_extract_all(content, '(?m)^#{{1,6}}\s+(.+)', 1), lambda h: octet_length(h::BLOB) > 2))) FROM chunk),
e AS (SELECT id, string_agg(name, '|' ORDER BY name) AS entities FROM (SELECT DISTINCT id, {clean} AS name FROM n) WHERE name <> '' GROUP BY id),
c AS (SELECT id, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM chunk GROUP BY id)
SELECT doc_id, sha256(md) AS sha256, coalesce(n_chunks, 0) AS n_chunks, coalesce(tokens, 0) AS tokens, coalesce(entities, '') AS entities FROM m LEFT JOIN c ON c.id = doc_id LEFT JOIN e ON e.id = doc_id""",
        "stats_bundle": f"WITH {_chunks('documents', 'doc_id', 'text')} SELECT (SELECT count(*) FROM documents) AS document_count, count(*) AS chunk_count, coalesce(sum(token_count), 0)::BIGINT AS total_tokens FROM chunk",
        "list_title_page": f"""WITH {_chunks("documents", "doc_id", "text")}, c AS (SELECT id, count(*) AS n FROM chunk GROUP BY id)
SELECT doc_id::VARCHAR AS document_id, 'Doc ' || doc_id AS title, source, sha256(text) AS sha256, coalesce(n, 0) AS chunk_count
FROM documents LEFT JOIN c ON id = doc_id ORDER BY title DESC, document_id LIMIT 25 OFFSET 10""",
        "get_with_chunks": f"""WITH {_chunks("documents", "doc_id", "text")}
SELECT id AS doc_id, 'Doc ' || id AS title, string_agg(idx || ':' || token_count || ':' || md5(content), ',' ORDER BY idx) AS chunk_list FROM chunk GROUP BY id""",
        "delete_cascade": f"""WITH {_chunks("documents", "doc_id", "text")}, c AS (SELECT id, count(*) AS n FROM chunk GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_chunks FROM documents LEFT JOIN c ON id = doc_id WHERE source <> 'src0'""",
        "delete_mentions": f"WITH {MENTIONS} SELECT DISTINCT doc_id, {clean} AS entity_id FROM f JOIN documents USING (doc_id) WHERE source <> 'src0'",
        "graph_traverse_limit": f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'en' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN edge ON src = node WHERE depth < 3),
m AS (SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node),
k AS (SELECT * FROM m WHERE depth > 0 ORDER BY depth, node LIMIT 25)
SELECT 'entity:' || node AS id, node AS name, 'node' AS kind, depth FROM (SELECT * FROM k UNION ALL SELECT * FROM m WHERE depth = 0)""",
        "graph_link": f"""WITH {EDGES}, w AS (SELECT src, relation, 1.0::DOUBLE AS weight FROM edge UNION ALL SELECT 'en', 'has', 0.5 UNION ALL SELECT 'en', 'has', 1.0)
SELECT src, relation, count(*) AS n, sum(weight) AS weight FROM w GROUP BY ALL""",
        "part_of_edges": "SELECT DISTINCT 'Lang ' || lang AS src, 'Doc ' || doc_id AS dst, 'part-of' AS relation FROM documents",
        "extended_entities": f"""WITH {MENTIONS}, x AS (SELECT doc_id, name, kind FROM f UNION SELECT doc_id, source, 'reference' FROM documents
  UNION SELECT doc_id, 'news', 'tag' FROM documents UNION SELECT doc_id, lang, 'tag' FROM documents UNION SELECT doc_id, 'Text ' || doc_id, 'alias' FROM documents)
SELECT name, kind, count(*) AS n FROM x GROUP BY ALL""",
        "tokenizer_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
        "plugged_entities": f"""WITH {MENTIONS}, x AS (SELECT doc_id, name, kind FROM f UNION ALL SELECT doc_id, unnest(regexp_extract_all(md, '[A-Za-z]{{14,}}')), 'long word' FROM md)
SELECT name, kind, count(*) AS n, min(doc_id) AS first_doc FROM x GROUP BY ALL""",
        "kb_keyword": f"""WITH {_once}, {_chunks("once", "sha256", "text")}, c AS (SELECT id || '#' || idx AS id, content FROM chunk),
{_bm25(PROBE, "c", "id", "content")} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= 10""",
        "kb_as_of": f"WITH {_once}, {_chunks('once', 'sha256', 'text')} SELECT sha256, count(*) AS n_chunks, source <> 'src1' AS kept FROM chunk JOIN once ON sha256 = id GROUP BY sha256, source",
        "kb_upload_twice": r"""WITH d AS (SELECT DISTINCT text FROM documents), a AS (SELECT DISTINCT 'again ' || source AS text FROM documents)
SELECT sha256(text) AS sha256, 'skipped' AS status, 0 AS tokens, 1 AS n_stored FROM d UNION ALL SELECT sha256(text), 'created', len(regexp_extract_all(text, '\S+')), 1 FROM a WHERE text NOT IN (SELECT text FROM d)""",
        "kb_vector": f"""WITH {_letters(_once, "SELECT item_id AS query_id, text FROM benchmark")}
SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, a.id, round({_LIKE}, 6) AS score FROM ce a, qe b) QUALIFY rank <= 5""",
        "kb_hybrid": f"""WITH {_letters(_once, "SELECT 0 AS query_id, 'ther hein' AS text")}, {_bm25(PROBE, "ce", "id", "content")},
vs AS (SELECT a.id, round({_LIKE}, 6) AS score FROM ce a, qe b),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= 30),
w AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= 30),
r AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 10""",
        "keyword_blocks_batch": rf"""WITH {_bm25(ITEMS, "documents", "doc_id", "text", False)}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(score, 4) AS score FROM kw QUALIFY rank <= 5""",
        "expand_nhop": f"""WITH RECURSIVE {_bm25("SELECT 0 AS query_id, unnest(['ther', 'hein']) AS term UNION ALL SELECT 1, unnest(['the', 'and'])", "documents", "doc_id", "text")},
h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= 5),
{MENTIONS}, mn AS (SELECT DISTINCT doc_id AS id, {clean} AS node FROM f), {EDGES},
we AS (SELECT src, dst, CASE relation WHEN 'has' THEN 1.0 WHEN 'next' THEN 0.9 WHEN 'first' THEN 0.8 ELSE 0.5 END::DOUBLE AS weight FROM edge),
r AS (SELECT query_id, node, 0 AS hop, score * 0.5::DOUBLE AS reach FROM h JOIN mn USING (id) WHERE rank <= 3
  UNION ALL SELECT query_id, dst, hop + 1, reach * 0.5::DOUBLE * weight FROM r JOIN we ON src = node WHERE hop < 2),
c AS (SELECT query_id, id, max(reach) AS reach FROM r JOIN mn USING (node) GROUP BY ALL),
x AS (SELECT query_id, id, round(reach, 6) AS score FROM c ANTI JOIN h USING (query_id, id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(reach, 6) DESC, id) <= 8)
SELECT query_id, id, round(score + coalesce(reach, 0), 6) AS score FROM h LEFT JOIN c USING (query_id, id) UNION ALL SELECT * FROM x""",
        "chunk_headings": f"""WITH p AS (SELECT doc_id, 'Before all.' || chr(10) || chr(10) AS p0, '# Doc ' || doc_id || chr(10) || chr(10) AS p1, '## Lang ' || lang || chr(10) || chr(10) || text || chr(10) || chr(10) AS p2,
  '### Part ' || source || chr(10) || text || chr(10) || chr(10) AS p3, '# The end' || chr(10) || text AS p4, 'Doc ' || doc_id AS h1, 'Lang ' || lang AS h2, 'Part ' || source AS h3 FROM documents),
m AS (SELECT doc_id, p0 || p1 || p2 || p3 || p4 AS md FROM p), {_chunks("m", "doc_id", "md")},
s AS (SELECT id AS doc_id, idx, coalesce(list_sum(list_transform(list_slice(t, 1, idx * 112), lambda x: length(x))), 0)::BIGINT AS start FROM cut)
SELECT doc_id, idx, start, CASE WHEN start < length(p0) THEN NULL WHEN start < length(p0 || p1) THEN h1 WHEN start < length(p0 || p1 || p2) THEN h1 || ' > ' || h2
  WHEN start < length(p0 || p1 || p2 || p3) THEN h1 || ' > ' || h2 || ' > ' || h3 ELSE 'The end' END AS heading FROM s JOIN p USING (doc_id)""",
        "kb_reindex": f"WITH {_once}, {_chunks('once', 'sha256', 'text', 64, 8)} SELECT id AS sha256, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM chunk GROUP BY id",
        "kb_reindex_partial": f"WITH {_once}, {_chunks('once', 'sha256', 'text', 64, 8)} SELECT id AS sha256, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM chunk JOIN once ON sha256 = id WHERE source <> 'src1' GROUP BY id",
        "kb_delete": rf"""WITH {_once}, {_chunks("once", "sha256", "text")}
SELECT sha256, count(*) AS n_chunks, coalesce(sum(len(regexp_extract_all(lower(content), '\p{{L}}+|\p{{N}}+'))), 0)::BIGINT AS terms FROM chunk JOIN once ON sha256 = id WHERE source <> 'src1' GROUP BY sha256""",
        "force_replace": """WITH s AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), n AS (SELECT min(doc_id) AS doc_id, sha256 FROM s WHERE doc_id % 3 = 0 GROUP BY sha256)
SELECT doc_id, sha256, 'old' AS version FROM s WHERE sha256 NOT IN (SELECT sha256 FROM n) UNION ALL SELECT doc_id, sha256, 'new' FROM n""",
        "new_documents": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0')",
        "mock_embeddings": f"""WITH {_chunks("documents", "doc_id", "text")}
SELECT id || '#' || idx AS chunk_id, repeat('0', (idx % 32 % 8)::INT) || '1' || repeat('0', (7 - idx % 32 % 8)::INT) AS bits FROM chunk""",
        "l2_normalize": f"""SELECT vec_id, (unnest(range(len(embedding))))::INT AS pos, unnest(list_transform(a.embedding::DOUBLE[], lambda x: round(x * 3 / (3 * {NORM.format("a")}), 5) + 0.0)) AS value FROM embeddings a""",
        "vector_topk": f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS id, round({COSINE}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0) QUALIFY rank <= 10",
        "vector_topk_batch": f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, round({COSINE}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) QUALIFY rank <= 10",
        "bm25_terms": r"""WITH b AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|\p{N}+') AS t FROM documents))
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, min(l) AS shortest FROM b GROUP BY term""",
        "keyword_topk": f"WITH {_bm25(PROBE, 'documents', 'doc_id', 'text')} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= 10",
        "keyword_any_batch": rf"""WITH {_bm25(ITEMS, "documents", "doc_id", "text", False)}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(score, 4) AS score FROM kw QUALIFY rank <= 5""",
        "hybrid_rrf": _hybrid(10) + "SELECT id, score, rank FROM h",
        "hybrid_filtered": _hybrid(30) + "SELECT h.id, score, rank FROM h JOIN documents d ON d.doc_id = h.id WHERE lang = 'en'",
        "entities_links": f"WITH {MENTIONS} " + entity.format("reference"),
        "entities_tags": f"WITH {MENTIONS} " + entity.format("tag"),
        "entities_sections": f"WITH {MENTIONS} " + entity.format("section"),
        "entity_upsert": f"WITH {MENTIONS} SELECT {clean} AS entity_id, arg_min(name, (doc_id, p)) AS name, arg_min(kind, (doc_id, p)) AS kind FROM f GROUP BY 1",
        "mentions_edges": f"WITH {MENTIONS} SELECT DISTINCT doc_id, {clean} AS entity_id FROM f",
        "entity_description_merge": f"""WITH {MENTIONS}, e AS (SELECT {clean} AS entity_id, arg_min(kind, (doc_id, p)) AS kind FROM f GROUP BY 1)
SELECT entity_id, kind, CASE WHEN entity_id IN (SELECT source FROM documents) THEN 'about ' || entity_id END AS description FROM e""",
        "graph_from_document": f"""WITH {MENTIONS}, {EDGES}, one AS (SELECT DISTINCT doc_id::VARCHAR AS start, {clean} AS node FROM f),
two AS (SELECT DISTINCT start, dst AS node FROM one JOIN edge ON src = node AND relation = 'has')
SELECT start, node, min(depth)::BIGINT AS depth FROM (SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL""",
        "graph_bfs": f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT lang AS start, lang AS node, 0 AS depth FROM documents
UNION SELECT start, dst, depth + 1 FROM r JOIN edge ON src = node WHERE depth < 4),
m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL)
SELECT m.start, m.node, m.depth::BIGINT AS depth, min(p.node) AS parent FROM m LEFT JOIN (SELECT p.start, p.node, p.depth, e.dst FROM m p JOIN edge e ON e.src = p.node) p
ON p.start = m.start AND p.dst = m.node AND p.depth = m.depth - 1 GROUP BY ALL""",
        "graph_bfs_relation": """WITH s AS (SELECT doc_id AS i FROM documents), r AS (SELECT i, i AS j, 0 AS depth FROM s UNION ALL SELECT i, i + 1, 1 FROM s UNION ALL SELECT a.i, a.i + 2, 2 FROM s a JOIN s b ON b.i = a.i + 1)
SELECT 'Doc ' || i AS start, 'Doc ' || j AS node, depth::BIGINT AS depth, CASE WHEN depth > 0 THEN 'Doc ' || (j - 1) END AS parent FROM r""",
        "graph_expand_hits": f"""WITH {_bm25("SELECT 0 AS query_id, unnest(['ther', 'hein']) AS term UNION ALL SELECT 1, unnest(['the', 'and'])", "documents", "doc_id", "text")},
h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kw QUALIFY rank <= 5),
{MENTIONS}, mn AS (SELECT DISTINCT doc_id, {clean} AS entity_id FROM f),
en AS (SELECT DISTINCT query_id, entity_id FROM h JOIN mn ON doc_id = id WHERE rank <= 3),
nb AS (SELECT query_id, doc_id AS id FROM en JOIN mn USING (entity_id) QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY doc_id) <= 8),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM (SELECT DISTINCT query_id, id FROM nb ANTI JOIN h USING (query_id, id)) QUALIFY k <= 8)
SELECT query_id, id, score, rank FROM h UNION ALL SELECT query_id, id, 1.0::DOUBLE, k + (SELECT max(rank) FROM h WHERE h.query_id = x.query_id) FROM x""",
        "reindex_dry_run": f"""WITH {MENTIONS}, {_chunks("md", "doc_id", "md")}
SELECT count(DISTINCT id) AS documents_processed, count(*) AS chunks_created, sum(token_count)::BIGINT AS tokens_total, (SELECT count(*) FROM f) AS entities_extracted FROM chunk""",
        "conversation_chunks": f"""WITH {_chunks("conversations", "(conv_id, turn)", "text", 32, 8)}
SELECT id[1] AS conv_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens, max(length(content)) AS longest FROM chunk GROUP BY 1""",
        "ordered_rank": "SELECT vec_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, label, round(embedding[1]::DOUBLE, 4) AS score FROM embeddings) QUALIFY rank <= 3",
    }
    return found | {"kb_graph_bfs": found["graph_bfs"]}
