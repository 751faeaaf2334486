"""DuckDB SQL for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

from .p5_quality import COMMON

WORD = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TERM = r"[\p{L}\p{M}\p{N}]+"
FIELD_ENDS = r"[\n\r\x0B\f\x{85}\x{2028}\x{2029}|;]+"
FIELD = r"^\s*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.''/-]*([ \t]+[\p{L}\p{M}\p{N}.''/&-]+){0,4}\s*:.*[\p{L}\p{M}\p{N}].*$"


def canon(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '{TERM}'), '')"


COPIES = rf"""WITH c AS (SELECT ingest_pos, {canon('text')} AS w, list_filter(regexp_split_to_array(text, '{FIELD_ENDS}'), lambda p: {canon('p')} <> '') AS ps FROM chunks WHERE text IS NOT NULL),
k AS (SELECT ingest_pos, w, CASE WHEN contains(array_to_string(ps, ' '), ':') AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '{FIELD}'))) = 0
  THEN 'fields ' || array_to_string(list_sort(list_transform(ps, lambda p: {canon('p')})), ' ') END AS f FROM c WHERE length(w) >= 20),
n AS (SELECT w, min(f) AS f FROM k WHERE f IS NOT NULL GROUP BY w),
g AS (SELECT k.ingest_pos, coalesce(k.f, n.f, k.w) AS key FROM k LEFT JOIN n USING (w)),
m AS (SELECT ingest_pos, min(ingest_pos) OVER (PARTITION BY key) AS keep_pos FROM g)"""


def runs(of: str, key: str, n: int) -> str:
    """Distinct runs of ``n`` consecutive terms of each row."""
    return f"""SELECT DISTINCT {key}, array_to_string(ts[i:i + {n - 1}], ' ') AS g FROM (
  SELECT {key}, ts, unnest(range(1, len(ts) - {n - 2})) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '{TERM}') AS ts FROM {of} WHERE text IS NOT NULL))"""


def sized(table: str, key: str) -> str:
    """Words of each text once, as a list."""
    return f"SELECT DISTINCT '{table}' AS src, {key}::VARCHAR AS item_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM {table} WHERE text IS NOT NULL"


NEAR = f"""t AS (SELECT ingest_pos, text FROM chunks WHERE len(regexp_extract_all(lower(text), '{TERM}')) >= 40), s AS ({runs('t', 'ingest_pos', 3)}),
n AS (SELECT ingest_pos, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.ingest_pos AS a, b.ingest_pos AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.ingest_pos < b.ingest_pos GROUP BY 1, 2),
near AS (SELECT a, b FROM o JOIN n x ON x.ingest_pos = a JOIN n y ON y.ingest_pos = b WHERE 17 * o >= 7 * (x.n + y.n))"""

ORACLE: dict[str, str] = {
    "p1_found": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM vector_rows WHERE embedding IS NOT NULL),
r AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0),
k AS (SELECT a, b FROM r WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM k""",
    "p2_found": f"""SELECT 'chunks' AS src, ingest_pos::VARCHAR AS item_id FROM chunks WHERE len(regexp_extract_all(text, '{WORD}')) > 375
UNION SELECT 'iltur_judgments', doc_id FROM iltur_judgments WHERE len(regexp_extract_all(text, '{WORD}')) > 375""",
    "p2_cover": f"SELECT src, item_id, len(ws)::INT AS words, md5(array_to_string(ws, ' ')) AS digest, true AS fits FROM ({sized('chunks', 'ingest_pos')} UNION ALL {sized('iltur_judgments', 'doc_id')})",
    "p4_found": f"WITH {NEAR} SELECT a AS pos_a, b AS pos_b FROM near",
    "p4_links": f"""WITH {NEAR}, k AS (SELECT ingest_pos, min(ingest_pos) OVER (PARTITION BY array_to_string(regexp_extract_all(lower(text), '{TERM}'), ' ')) AS rep FROM chunks WHERE text IS NOT NULL),
l AS (SELECT x.rep AS rep, count(DISTINCT y.rep) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) p JOIN k x ON x.ingest_pos = p.a JOIN k y ON y.ingest_pos = p.b WHERE x.rep <> y.rep GROUP BY 1)
SELECT k.ingest_pos, k.rep, coalesce(l.n, 0) AS n_links FROM k LEFT JOIN l USING (rep)""",
    "p5_counts": f"""WITH w AS (SELECT ingest_pos, word_count, text, regexp_extract_all(text, '{WORD}') AS ws, regexp_extract_all(lower(text), '{TERM}') AS ts FROM chunks)
SELECT ingest_pos, len(ws) AS words, CASE WHEN text IS NOT NULL THEN coalesce(word_count <> len(ws), true) END AS bad_count,
  round(len(list_filter(ts, lambda t: list_contains([{', '.join(f"'{c}'" for c in sorted(COMMON))}], t))) / greatest(1, len(ws)), 9) AS common_share,
  round(length(array_to_string(ws, '')) / greatest(1, len(ws)), 9) AS mean_word_length, round(len(list_distinct(ts)) / greatest(1, len(ts)), 9) AS distinct_share FROM w""",
    "p6_found": """WITH r AS (SELECT c.ingest_pos, source, row_number() OVER (PARTITION BY source, doc_type ORDER BY quality DESC NULLS LAST, c.ingest_pos) AS rank FROM chunks c LEFT JOIN chunk_scores s USING (ingest_pos))
SELECT ingest_pos FROM r WHERE source IS NOT NULL AND rank > (SELECT 3 * count(*) // 100 FROM chunks)""",
    "p7_found": f"{COPIES} SELECT keep_pos, ingest_pos AS copy_pos FROM m WHERE ingest_pos > keep_pos",
    "p7_copies_count": f"{COPIES} SELECT keep_pos, count(*) AS n_copies FROM m GROUP BY 1 HAVING count(*) > 1",
    "p7_records": f"{COPIES} SELECT coalesce(keep_pos, c.ingest_pos) AS keep_pos, count(*) AS n_copies FROM chunks c LEFT JOIN m USING (ingest_pos) GROUP BY 1",
    "p7_members": f"{COPIES} SELECT coalesce(keep_pos, c.ingest_pos) AS keep_pos, c.ingest_pos, c.chunk_id FROM chunks c LEFT JOIN m USING (ingest_pos)",
    "p9_found": f"WITH d AS ({runs('documents', 'doc_id', 13)}), i AS ({runs('eval_items', 'item_id', 13)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p10_restored": "SELECT doc_id, md5(text) AS digest FROM documents",
}
