"""DuckDB SQL for the queries of the core."""

from __future__ import annotations

from ..functions import generate as G
from ..functions import text as T
from ..operators import answer as A

WS = T.WS


def _q(s: str) -> str:
    return s.replace("'", "''")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '(?m){T.PAGE_NUMBER}', '', 'g')"
    x = f"regexp_replace({x}, '{T.HEADERS}', '', 'g')"
    x = f"regexp_replace({x}, '(?m){T.SEPARATOR}', '', 'g')"
    x = rf"regexp_replace({x}, '{T.HYPHENATED}', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?m){T.SYMBOLS}', '', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def header(x: str) -> str:
    parts = ", ".join(f"nullif(regexp_extract({strip(x)}, '{p}', 1), '')" for p in T.SECTIONS)
    return f"left({strip(f'coalesce({parts})')}, 80)"


def paras(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '')"


def sents(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '{T.SENTENCE_END}', '\1' || chr(1), 'g'), chr(1))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def slug(x: str) -> str:
    return f"left(regexp_replace(lower({x}), '[^a-z0-9]', '_', 'g'), 25)"


STATUTES = f"""statutes AS (
  SELECT f.filename, f.source, f.doc_type, {clean("string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_num, p.text)")} AS text
  FROM statute_pages p JOIN statute_files f USING (filename) WHERE {strip('p.text')} <> '' GROUP BY ALL)"""
JUDGMENTS = f"""judgments AS (
  SELECT doc_id, {clean('text')} AS text, 'SC Judgment — ' || coalesce(source_config, 'iltur') AS source, doc_type, court, source_config
  FROM (SELECT DISTINCT * FROM iltur_judgments))"""


def chunks(of: str, key: str, name: str) -> str:
    """Common table expressions that end with the chunks of a table, under ``name``."""
    n = name
    return f"""
{n}_docs AS (SELECT row_number() OVER () AS d, * FROM {of} WHERE text IS NOT NULL),
{n}_paras AS (SELECT d, i, ps[i] AS p FROM (SELECT d, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT d, {paras('text')} AS ps FROM {n}_docs))),
{n}_sized AS (SELECT d, i, p, len({words('p')}) AS n, {header('p')} AS label FROM {n}_paras),
{n}_parts AS (SELECT d, i, label, CASE WHEN n <= 375 THEN [p] ELSE {sents('p')} END AS us FROM {n}_sized),
{n}_units AS (
  SELECT d, row_number() OVER (PARTITION BY d ORDER BY i, j) AS u, label, len({words('us[j]')}) AS n
  FROM (SELECT d, i, label, us, unnest(range(1, len(us) + 1)) AS j FROM {n}_parts)),
{n}_fold(d, u, s, e, label, ps, pe) AS (
  SELECT d, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM {n}_docs
  UNION ALL
  SELECT f.d, x.u, CASE WHEN f.e - f.s + x.n > 375 AND f.e > f.s THEN greatest(f.s, f.e - 38) ELSE f.s END, f.e + x.n, coalesce(x.label, f.label),
    CASE WHEN f.e - f.s + x.n > 375 AND f.e > f.s THEN f.s END, CASE WHEN f.e - f.s + x.n > 375 AND f.e > f.s THEN f.e END
  FROM {n}_fold f JOIN {n}_units x ON x.d = f.d AND x.u = f.u + 1),
{n}_pieces AS (
  SELECT d, u, ps AS s, pe AS e, label FROM {n}_fold WHERE ps IS NOT NULL
  UNION ALL
  SELECT d, u + 1, s, e, label FROM {n}_fold f WHERE u = (SELECT max(u) FROM {n}_fold g WHERE g.d = f.d) AND e > s),
{n}_texts AS (
  SELECT p.d, p.u, array_to_string(list_slice({words('t.text')}, p.s + 1, p.e), ' ') AS text, coalesce(p.label, '') AS section, (p.e - p.s)::INT AS word_count
  FROM {n}_pieces p JOIN {n}_docs t USING (d)),
{n} AS (
  SELECT t.* EXCLUDE (d, text), row_number() OVER (PARTITION BY c.d ORDER BY c.u)::INT AS chunk_no, c.text, c.section, c.word_count,
    {slug('t.source')} || '_' || lpad((row_number() OVER (PARTITION BY c.d ORDER BY c.u))::VARCHAR, 5, '0') || '_' || left(md5(c.text), 6) AS chunk_id
  FROM {n}_texts c JOIN {n}_docs t USING (d) WHERE length(c.text) >= 50)"""


CHUNKED = f"WITH RECURSIVE {JUDGMENTS}, {STATUTES}, {chunks('judgments', 'doc_id', 'jc')}, {chunks('statutes', 'filename', 'sc')}"
ORIGINS = """SELECT chunk_id, source, doc_type, NULL AS court, 'statutes' AS origin FROM sc
UNION ALL SELECT chunk_id, source, doc_type, court, 'judgments' FROM jc
UNION ALL SELECT chunk_id, source, doc_type, court, 'prechunked' FROM chunks"""


def bow(name: str, of: str, key: str, column: str) -> str:
    tokens = words(rf"regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')")
    return f"""
{name}_t AS (SELECT {key}, unnest({tokens}) AS w FROM {of}),
{name}_n AS (SELECT {key}, (('0x' || left(md5(w), 8))::BIGINT % 384)::INT AS bucket, count(*)::BIGINT AS n FROM {name}_t GROUP BY 1, 2),
{name} AS (SELECT {key}, bucket, n / sqrt(sum((n * n)::DOUBLE) OVER (PARTITION BY {key})) AS weight FROM {name}_n)"""


ASKED = "SELECT response_id, query_used FROM orchestrator_responses WHERE response_id % 20 = 0 AND query_used IS NOT NULL"


def searched(asked: str) -> str:
    """Common table expressions of a search for the rows (response_id, query_used) of ``asked``."""
    return f"""WITH asked AS ({asked}),
{bow('q', 'asked', 'response_id', 'query_used')},
{bow('x', 'chunks', 'ingest_pos', 'text')},
cosines AS (SELECT response_id, ingest_pos, sum(q.weight * x.weight) AS cosine FROM q JOIN x USING (bucket) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY round(cosine, 10) DESC, ingest_pos)::INT AS rank, round((1 + cosine) / 2, 4) AS score FROM cosines),
hits AS (SELECT response_id, ingest_pos, rank, score FROM best WHERE rank <= 5 AND score >= 0.25),
found AS (SELECT h.*, c.source, c.section, c.doc_type, c.text FROM hits h JOIN chunks c USING (ingest_pos)),
cited AS (SELECT *, row_number() OVER (PARTITION BY response_id, source, section ORDER BY rank) AS place FROM found)"""


HITS = searched(ASKED)
N = "chr(10)"
T_ = A.TEMPLATE


def lit(text: str) -> str:
    return f"'{_q(text)}'"


DUTIES = "".join(f"\n- {d}" for d in T_.duties)
#: After :func:`searched`: prompts, and the answers of the extractive generator with their citations.
PROMPTS = f""", blocks AS (
  SELECT response_id, count(*) AS n_hits, max(score) AS best_score, string_agg('--- Passage ' || rank || ' ---' || {N} || 'Source: ' || coalesce(source, 'Unknown Source') || ' | Type: ' || coalesce(doc_type, '')
    || CASE WHEN coalesce(section, '') <> '' THEN ' | Section: ' || section ELSE '' END || {N} || coalesce(text, ''), {N} || {N} ORDER BY rank) AS context FROM found GROUP BY 1),
prompts AS (SELECT response_id, query_used, coalesce(n_hits, 0) AS n_hits, best_score,
  CASE WHEN context IS NOT NULL THEN {lit(f'## {T_.passages}')} || {N} || {N} || context || {N} || {N} || {lit(f'## {T_.question}')} || {N} || {N} || query_used || {lit(f"{chr(10)}{chr(10)}## {T_.duties_head}{chr(10)}{DUTIES}{chr(10)}{chr(10)}{T_.cue}")}
  ELSE {lit(f'## {T_.question}')} || {N} || {N} || query_used || {N} || {N} || {lit(T_.no_passages)} END AS prompt FROM asked LEFT JOIN blocks USING (response_id))"""
FIRST = "'--- Passage 1 ---\n[^\n]*\n((?s:.{0,300}))'"
ANSWERS = f"""{PROMPTS},
lists AS (SELECT response_id, count(*) AS n_citations, string_agg(concat_ws(' | ', coalesce(source, ''), coalesce(section, ''), coalesce(doc_type, ''), score::VARCHAR), '; ' ORDER BY rank) AS citations,
  string_agg({N} || '  ' || n || '. ' || upper(coalesce(doc_type, '')) || ' ' || coalesce(source, 'Unknown Source') || CASE WHEN coalesce(section, '') <> '' THEN ', ' || left(section, 55) ELSE '' END || ' (' || score::VARCHAR || ')', '' ORDER BY rank) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY rank) AS n FROM cited WHERE place = 1) GROUP BY 1),
answers AS (SELECT response_id, query_used, n_hits, best_score, coalesce(n_citations, 0) AS n_citations, coalesce(citations, '') AS citations, shown, n_hits > 0 AS context_used, CASE WHEN n_hits = 0 THEN {lit(A.WARNING)} END AS warning,
  CASE WHEN regexp_matches(prompt, {FIRST}) THEN {lit(G.QUOTED + ' ')} || regexp_extract(prompt, {FIRST}, 1) ELSE {lit(G.NOTHING)} END || {N} || {N} || {lit(G.NOTICE)} AS answer FROM prompts LEFT JOIN lists USING (response_id))"""
UPLOADS = f"""SELECT *, CASE WHEN mime = 'text/plain' THEN 415 WHEN bytes = 0 THEN 400 WHEN {strip("coalesce(extracted_text, '')")} = '' THEN 422 ELSE 200 END AS status,
  CASE WHEN mime = 'text/plain' THEN 415 WHEN bytes = 0 THEN 400 WHEN extracted_text IS NULL THEN 422 ELSE 200 END AS readable FROM (
  SELECT response_id, query_used AS question, extracted_text, coalesce(length(answer), 0) AS bytes, CASE WHEN response_id % 60 = 0 THEN 'image/png' WHEN flow = 'document_upload' THEN 'application/pdf' ELSE 'text/plain' END AS mime
  FROM orchestrator_responses WHERE response_id % 20 = 0)"""


def document_query(text: str, question: str) -> str:
    return f"""{lit(T_.document)} || {N} || {N} || left({text}, 3000) || {N} || {N} || CASE WHEN {strip(f"coalesce({question}, '')")} <> '' THEN {lit(T_.about_document + ' ')} || {question} ELSE {lit(T_.no_question)} END"""


def status(limit: str) -> str:
    return f"CASE WHEN {strip('a.query_used')} = '' {limit} THEN 400 ELSE 200 END"


SUMM = f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE WHEN court IS NOT NULL THEN doc_id END AS id, t AS text, summary FROM (
  SELECT *, coalesce(nullif(text, ''), summary) AS t FROM (SELECT DISTINCT * FROM iltur_judgments WHERE source_config = 'summ')) WHERE {strip('t')} <> ''"""
BAIL = f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, t AS text FROM (
  SELECT *, coalesce(nullif(text, ''), court) AS t FROM (SELECT DISTINCT * FROM iltur_judgments WHERE source_config = 'bail')) WHERE {strip('t')} <> ''"""


def summ() -> str:
    return f"SELECT coalesce(id, i::VARCHAR) AS doc_id, text, summary, 'Supreme Court of India' AS court, 'judgment' AS doc_type, 'summ' AS source_config FROM ({SUMM})"


def bail(first: str = "0") -> str:
    return f"SELECT 'bail_' || (i + {first}) AS doc_id, text, NULL::VARCHAR AS summary, 'Supreme Court of India' AS court, 'judgment' AS doc_type, 'bail' AS source_config FROM ({BAIL})"


def dense(k: int, where: str = "true", least: str = "true") -> str:
    return f"""SELECT query_id, vec_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 10) DESC, vec_id)::INT AS rank, round((1 + cosine) / 2, 4) AS score FROM (
    SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v))) AS cosine
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}) x))
WHERE rank <= {k} AND {least}"""


ORACLE: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "clean_pages": f"SELECT filename, page_num, {clean('text')} AS cleaned FROM statute_pages",
    "section_header": f"SELECT ingest_pos, {header('text')} AS from_text, {header('section')} AS from_section FROM chunks WHERE text IS NOT NULL",
    "paragraphs": f"SELECT doc_id, i::INT AS paragraph_no, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, {paras('text')} AS ps FROM (SELECT DISTINCT doc_id, text FROM iltur_judgments WHERE text IS NOT NULL)))",
    "sentences": f"SELECT doc_id, i::INT AS sentence_no, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS ss FROM documents WHERE text IS NOT NULL))",
    "word_count": f"SELECT ingest_pos, len({words('text')})::INT AS words FROM chunks",
    "chunk_keys": f"SELECT ingest_pos, {slug('source')} AS slug, left(md5(text), 6) AS hash, {slug(chr(99) + 'oalesce(source, ' + chr(39) * 2 + ')')} || '_' || lpad(ingest_pos::VARCHAR, greatest(5, length(ingest_pos::VARCHAR))::INT, '0') || '_' || left(md5(coalesce(text, '')), 6) AS made_id FROM chunks",
    "falsy_coalesce": "SELECT doc_id, coalesce(nullif(summary, ''), nullif(text, ''), '') AS chosen, 'SC Judgment — ' || coalesce(source_config, 'iltur') AS label FROM (SELECT DISTINCT * FROM iltur_judgments)",
    "metadata_projection": "SELECT ingest_pos, coalesce(source, '') AS source, coalesce(doc_type, '') AS doc_type, coalesce(section, '') AS section, coalesce(court, '') AS court, coalesce(word_count::VARCHAR, '0') AS word_count FROM chunks",
    "ocr_lines": rf"SELECT response_id, array_to_string(list_filter(list_transform(regexp_split_to_array(extracted_text, '\r\n|[\n\r\x0B\x0C\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {strip('l')}), lambda l: l <> ''), chr(10)) AS lines FROM orchestrator_responses",
    "previews": "SELECT ingest_pos, left(text, 250) AS preview, coalesce(nullif(section, ''), 'N/A') AS section_label, upper(doc_type) AS type_label FROM chunks",
    "echo_trunc": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS echo FROM documents",
    "page_concat": f"WITH {STATUTES} SELECT filename, source, text FROM statutes",
    "manifest_lookup": "SELECT f.filename, f.source, f.doc_type, count(*) AS n_pages FROM statute_pages p JOIN statute_files f USING (filename) GROUP BY ALL",
    "ocr_pages": rf"SELECT filename, string_agg('--- Page ' || page_num || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY page_num, t) AS text FROM (SELECT filename, page_num, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {strip('l')}), lambda l: l <> ''), chr(10)) AS t FROM statute_pages) WHERE length(t) > 0 GROUP BY filename",
    "prechunked": f"SELECT text, coalesce(source, 'Supreme Court of India') AS source, 'judgment' AS doc_type, 'hf_sc_' || lpad((row_number() OVER (ORDER BY ingest_pos) - 1)::VARCHAR, 5, '0') AS chunk_id FROM chunks WHERE {strip('text')} <> ''",
    "chunk_judgments": f"{CHUNKED} SELECT doc_id, court, source_config, chunk_no, text, source, doc_type, section, word_count, chunk_id FROM jc",
    "chunk_statutes": f"{CHUNKED} SELECT filename, chunk_no, text, source, doc_type, section, word_count, chunk_id FROM sc",
    "sample_docs": "SELECT doc_id, source FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 300",
    "shuffle_take": "SELECT ingest_pos, text FROM chunks WHERE length(trim(text)) >= 80 ORDER BY md5('42' || ingest_pos), ingest_pos LIMIT 200",
    "cap_chunks": f"{CHUNKED} SELECT doc_id, chunk_no, chunk_id FROM jc ORDER BY md5('42' || doc_id), doc_id, chunk_no LIMIT 100",
    "union_sources": f"{CHUNKED} {ORIGINS}",
    "count_by_type": "SELECT coalesce(doc_type, 'unknown') AS doc_type, count(*) AS n FROM chunks GROUP BY 1",
    "summary_rollup": f"{CHUNKED} SELECT origin, count(*) AS n, grouping(origin)::INT AS total FROM ({ORIGINS}) GROUP BY ROLLUP (origin)",
    "ingest_antijoin": "SELECT chunk_id, ingest_pos FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM vector_rows v WHERE v.id = c.chunk_id)",
    "dedup_first": "SELECT chunk_id, ingest_pos, source FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_pos) = 1",
    "ingest_batches": "SELECT ingest_pos, chunk_id, ((row_number() OVER (ORDER BY ingest_pos) - 1) // 16)::BIGINT AS batch_no FROM chunks",
    "vector_topk": dense(10),
    "vector_topk_filtered": dense(5, "label = 3"),
    "vector_topk_threshold": dense(10, "true", "score >= 0.6"),
    "embed_bow": f"WITH {bow('x', 'documents', 'doc_id', 'text')} SELECT doc_id, bucket, round(weight, 6) AS weight FROM x",
    "text_search": f"{HITS} SELECT response_id, ingest_pos, rank, score FROM hits",
    "citations_distinct": f"{HITS} SELECT response_id, source, section, doc_type, score FROM cited WHERE place = 1",
    "prompt_build": f"{HITS}{PROMPTS} SELECT response_id, prompt, n_hits FROM prompts",
    "rag_response": f"{HITS}{ANSWERS} SELECT response_id, n_hits, n_citations, best_score, context_used, warning FROM answers",
    "rag_answer": f"{searched(f'SELECT * FROM ({ASKED}) a WHERE ' + status('OR length(a.query_used) > 1000') + ' = 200')}{ANSWERS} SELECT response_id, {status('OR length(a.query_used) > 1000')} AS status, a.query_used AS query, answer, citations, context_used, warning FROM ({ASKED}) a LEFT JOIN answers USING (response_id)",
    "text_flow": f"{searched(f'SELECT * FROM ({ASKED}) a WHERE ' + status('') + ' = 200')}{ANSWERS} SELECT response_id, 'text_query' AS flow, {status('')} AS status, a.query_used, answer, citations, context_used, warning FROM ({ASKED}) a LEFT JOIN answers USING (response_id)",
    "document_flow": f"""{searched(f"SELECT response_id, {document_query('extracted_text', 'question')} AS query_used FROM ({UPLOADS}) WHERE status = 200")}{ANSWERS}
SELECT response_id, 'document_upload' AS flow, status, CASE WHEN status = 200 THEN coalesce(nullif({strip('question')}, ''), {lit(T_.document_label)}) END AS query_used, answer, citations, context_used, warning,
  CASE WHEN status = 200 THEN CASE WHEN length(extracted_text) > 500 THEN left(extracted_text, 500) || '...' ELSE extracted_text END END AS extracted_text FROM ({UPLOADS}) LEFT JOIN answers USING (response_id)""",
    "document_analyze": f"""SELECT response_id, readable AS status, 'upload_' || response_id AS filename, CASE WHEN readable = 200 THEN CASE WHEN mime = 'application/pdf' THEN 'pdf' ELSE 'image' END END AS file_type,
  CASE WHEN readable = 200 THEN length(extracted_text)::INT END AS character_count, CASE WHEN readable = 200 THEN extracted_text END AS extracted_text, CASE WHEN readable = 200 THEN {strip('extracted_text')} <> '' END AS success FROM ({UPLOADS})""",
    "citation_lists": f"{HITS}{ANSWERS} SELECT response_id, citations FROM lists",
    "pretty_print": f"{HITS}{ANSWERS} SELECT response_id, 'Question: ' || query_used || {N} || {N} || answer || coalesce({N} || {N} || 'Sources:' || shown, '') || coalesce({N} || {N} || 'Warning: ' || warning, '') AS shown FROM answers",
    "citations_stored": "SELECT response_id, source, section, doc_type, score FROM (SELECT response_id, i, c.source, c.section, c.doc_type, c.score FROM (SELECT response_id, i, citations[i] AS c FROM (SELECT response_id, citations, unnest(range(1, len(citations) + 1)) AS i FROM orchestrator_responses))) QUALIFY row_number() OVER (PARTITION BY response_id, source, section ORDER BY i) = 1",
    "doc_query_template": f"SELECT response_id, {document_query('extracted_text', 'query_used')} AS query, coalesce(nullif({strip('query_used')}, ''), {lit(T_.document_label)}) AS label FROM orchestrator_responses WHERE extracted_text IS NOT NULL",
    "validate_request": f"SELECT doc_id, CASE WHEN text IS NULL OR {strip('text')} = '' OR length(text) > 1000 THEN 400 ELSE 200 END AS limited, CASE WHEN text IS NULL OR {strip('text')} = '' THEN 400 ELSE 200 END AS unlimited FROM documents",
    "validate_upload": "SELECT doc_id, CASE WHEN coalesce(doc_kind, '') NOT IN ('notice', 'order') THEN 415 WHEN coalesce(length(text), 0) = 0 THEN 400 WHEN NOT coalesce(lang <> 'und', false) THEN 422 ELSE 200 END AS status FROM documents",
    "health_rollup": "SELECT CASE WHEN bool_and(warning IS NULL) THEN 'healthy' ELSE 'degraded' END AS overall FROM orchestrator_responses",
    "health_services": f"SELECT 'ok — ' || count(*) || ' chunks indexed' AS store, 'ok — bag of words, 384' AS embedder, 'ok — extractive' AS generator, 'healthy' AS overall FROM vector_rows",
    "judgments_summ": summ(),
    "judgments_bail": bail(),
    "judgments_union": f"{summ()} UNION ALL {bail(f'(SELECT count(*) FROM ({SUMM}))')}",
    "files_by_kind": r"SELECT name, CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(name), '\.(jpg|jpeg|png|tiff|bmp)$') THEN 'image' ELSE 'unsupported' END AS file_type FROM (SELECT filename || unnest(['', '.PNG', '.tif', '.tiff']) AS name FROM statute_files)",
    "json_array_round_trip": "SELECT filename, source, doc_type FROM statute_files",
    "dataset_split": "SELECT filename, source, doc_type FROM statute_files",
    "vector_append": "SELECT chunk_id, ingest_pos FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN ingest_pos % 3 = 0 THEN 0 ELSE 1 END, ingest_pos) = 1",
    "vector_truncate": "SELECT count(DISTINCT chunk_id) AS n_before, 0::BIGINT AS n_after FROM chunks",
    "stream_ingest": "SELECT chunk_id, ingest_pos FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_pos) = 1",
    "ingest_progress": "SELECT b AS batch_no, n AS n_batches, added, total, round(100.0 * added / total, 1) AS pct, 1.5 * (b + 1) / added * (total - added) AS eta_s FROM (SELECT b, (total + 15) // 16 AS n, least((b + 1) * 16, total) AS added, total FROM (SELECT total, unnest(range((total + 15) // 16)) AS b FROM (SELECT count(*) AS total FROM chunks)))",
    "random_peek": "SELECT ingest_pos, left(source, 55) AS source, coalesce(nullif(left(section, 60), ''), '—') AS section, left(text, 180) AS preview FROM chunks WHERE text IS NOT NULL ORDER BY md5('7' || ingest_pos), ingest_pos LIMIT 3",
    "build_corpus": f"""WITH RECURSIVE {STATUTES}, sampled AS (SELECT * FROM (SELECT DISTINCT doc_id, text, doc_type, court, source_config FROM iltur_judgments) ORDER BY md5('42' || doc_id), doc_id LIMIT 3000),
judgments AS (SELECT doc_id, {clean('text')} AS text, 'SC Judgment — ' || coalesce(source_config, 'iltur') AS source, doc_type, court, source_config FROM sampled), {chunks('judgments', 'doc_id', 'jc')}, {chunks('statutes', 'filename', 'sc')},
ready AS (SELECT ingest_pos, chunk_id, {clean('text')} AS t, source FROM chunks), taken AS (SELECT *, row_number() OVER (ORDER BY md5('42' || ingest_pos)) - 1 AS i FROM (SELECT * FROM ready WHERE length(t) >= 80 ORDER BY md5('42' || ingest_pos), ingest_pos LIMIT 2000))
SELECT chunk_id, source, doc_type, section, word_count, NULL AS court, 'statutes' AS origin FROM sc
UNION ALL (SELECT chunk_id, source, doc_type, section, word_count, court, 'judgments' FROM jc ORDER BY md5('42' || doc_id), doc_id, chunk_no LIMIT 1000)
UNION ALL SELECT coalesce(nullif(chunk_id, ''), 'sc_' || lpad(i::VARCHAR, 5, '0')), coalesce(source, 'Supreme Court of India'), 'judgment', '', len({words('t')})::INT, NULL, 'prechunked' FROM taken""",
}
