"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from ravelin.config import CHUNK_NAMESPACE, NOT_FOUND, STOPWORDS
from ravelin.operators.prompt import SYSTEM

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_FENCE = "```"


def _tokens(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{_FENCE}[\\s\\S]*?{_FENCE}', ' ', 'g'), '`[^`]+`', ' ', 'g')"
    words = f"string_split_regex(regexp_replace({plain}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+')"
    return f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))"


def _number(term: str) -> str:
    fold = f"list_reduce(list_transform(string_split({term}, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 33 + c) % 4294967296, 5381::BIGINT)"
    return f"abs(CASE WHEN {fold} >= 2147483648 THEN {fold} - 4294967296 ELSE {fold} END) % 500000"


def _uuid(source: str, content: str) -> str:
    h = f"sha1(unhex('{CHUNK_NAMESPACE.replace('-', '')}') || encode({source} || '::' || {content}))"
    variant = f"substr('89ab', (strpos('0123456789abcdef', {h}[17]) - 1) % 4 + 1, 1)"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || {variant} || {h}[18:20] || '-' || {h}[21:32]"


_FILES = "files AS (SELECT doc_id, source || '/' || doc_id || '.md' AS source, text AS content FROM documents)"
_DIFF = f"""{_FILES}, cur AS (SELECT source, md5(coalesce(content, '')) AS hash FROM files
), prev AS (
  SELECT source || '/' || doc_id || '.md' AS source, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash
  FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'gone/' || range || '.md', md5(range::VARCHAR) FROM range(5)
), changed AS (SELECT source FROM cur ANTI JOIN prev USING (source, hash))"""
_MARKDOWN = r"""md AS (
  SELECT 'chat/' || conv_id || '.md' AS source, '# Conversation ' || conv_id || E'\n\n' || string_agg(
    (CASE WHEN turn % 3 = 2 THEN '### ' ELSE '## ' END) || role || ' ' || turn || E'\n\n' || coalesce(text, ''), E'\n\n' ORDER BY turn) AS content
  FROM conversations GROUP BY conv_id
), titled AS (
  SELECT source, coalesce(nullif(regexp_extract(content, '(?m)^#\s+([^\r\n]+)', 1), ''),
    regexp_replace(string_split(source, '/')[-1], '\.[^.]*$', '')) AS title, content FROM md
)"""
_TITLED_FILES = _FILES + r""", titled AS (
  SELECT source, coalesce(nullif(regexp_extract(content, '(?m)^#\s+([^\r\n]+)', 1), ''),
    regexp_replace(string_split(source, '/')[-1], '\.[^.]*$', '')) AS title, content FROM files
)"""
_SECTIONS_OF_TITLED = r"""lines AS (
  SELECT source, title, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT source, title, string_split(coalesce(content, ''), E'\n') AS l FROM titled)
), levels AS (
  SELECT *, CASE WHEN regexp_matches(line, '^###\s+[^\r\n]') THEN 3 WHEN regexp_matches(line, '^##\s+[^\r\n]') THEN 2
    WHEN regexp_matches(line, '^#\s+[^\r\n]') THEN 1 ELSE 0 END AS level,
    regexp_replace(regexp_extract(line, '^#{1,3}\s+(.+)$', 1), '^[\s]+|[\s]+$', '', 'g') AS name FROM lines
), paths AS (
  SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS section_ord,
    last_value(CASE WHEN level = 1 THEN name END IGNORE NULLS) OVER w AS h1,
    last_value(CASE WHEN level = 2 THEN name WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS h2,
    last_value(CASE WHEN level = 3 THEN name WHEN level IN (1, 2) THEN '' END IGNORE NULLS) OVER w AS h3
  FROM levels WINDOW w AS (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING)
), sections AS (
  SELECT * FROM (
    SELECT source, section_ord::INTEGER AS section_ord,
      coalesce(nullif(concat_ws(' > ', nullif(h1, ''), nullif(h2, ''), nullif(h3, '')), ''), title) AS heading_path,
      regexp_replace(string_agg(line, E'\n' ORDER BY pos), '^[\s]+|[\s]+$', '', 'g') AS content
    FROM paths WHERE level = 0 GROUP BY ALL) WHERE content <> ''
)"""
_SECTIONS = f"{_MARKDOWN}, {_SECTIONS_OF_TITLED}"


def _cut_level(d: int, mark: str) -> str:
    """Texts t{d} cut at ``mark``: pieces p{d}, and texts t{d + 1} that are still too long.

    Units of 1,500 characters or more are cut further.  The others between two of these make a run: a piece that starts at
    unit s ends where 1,500 characters end, and the next one starts at the first unit that leaves 150 before it.
    """
    return f"""u{d} AS (
  SELECT source, section_ord, path, i, x, length(x) AS n FROM (
    SELECT source, section_ord, path, unnest(us) AS x, unnest(range(len(us))) AS i FROM (
      SELECT source, section_ord, path, list_filter(list_transform(string_split(t, {mark}), lambda p, k: CASE WHEN k = 1 THEN p ELSE {mark} || p END), lambda p: p <> '') AS us
      FROM t{d} WHERE contains(t, {mark})))
), n{d} AS (
  SELECT *, sum((n >= 1500)::INTEGER) OVER (PARTITION BY source, section_ord, path ORDER BY i) AS run FROM u{d}
), r{d} AS (
  SELECT source, section_ord, path, min(i) AS first, list(x ORDER BY i) AS us, list_concat([0::HUGEINT], list(until ORDER BY i)) AS c FROM (
    SELECT *, sum(n) OVER (PARTITION BY source, section_ord, path, run ORDER BY i) AS until FROM n{d} WHERE n < 1500)
  GROUP BY source, section_ord, path, run
), c{d} AS (
  SELECT source, section_ord, path, first, us, c, 0::BIGINT AS s, len(list_filter(c, lambda x: x <= 1500)) - 1 AS e FROM r{d}
  UNION ALL
  SELECT source, section_ord, path, first, us, c, s, len(list_filter(c, lambda x: x <= c[s + 1] + 1500)) - 1 FROM (
    SELECT * REPLACE (len(list_filter(c, lambda x: x < greatest(c[e + 1] - 150, c[e + 2] - 1500))) AS s) FROM c{d} WHERE e < len(us))
), p{d} AS (SELECT source, section_ord, list_append(path, first + s) AS path, array_to_string(us[s + 1:e], '') AS piece FROM c{d}
), t{d + 1} AS (
  SELECT source, section_ord, list_append(path, i) AS path, x AS t FROM u{d} WHERE n >= 1500
  UNION ALL SELECT source, section_ord, path, t FROM t{d} WHERE NOT contains(t, {mark})
)"""


_MARKS = ("E'\\n\\n'", "E'\\n'", "'. '", "' '")
_SPACE = r"[\s\x0B\x{A0}\x{FEFF}]+"
_CHUNKS_OF_SECTIONS = f"""t0 AS (SELECT source, section_ord, [0::BIGINT] AS path, content AS t FROM sections WHERE length(content) > 1500
), {", ".join(_cut_level(d, mark) for d, mark in enumerate(_MARKS))}, hard AS (
  SELECT source, section_ord, list_append(path, k) AS path, substr(t, k * 1500 + 1, 1500) AS piece
  FROM (SELECT source, section_ord, path, t, unnest(range((length(t) - 1) // 1500 + 1)) AS k FROM t{len(_MARKS)})
), pieces AS (
  SELECT source, section_ord, path, regexp_replace(piece, '^{_SPACE}|{_SPACE}$', '', 'g') AS piece
  FROM (FROM hard {"".join(f" UNION ALL FROM p{d}" for d in range(len(_MARKS)))})
  UNION ALL SELECT source, section_ord, [0], content FROM sections WHERE length(content) <= 1500
), chunks AS (
  SELECT source, heading_path AS section_title, section_ord, (row_number() OVER (PARTITION BY source, section_ord ORDER BY path) - 1)::INTEGER AS chunk_index,
    heading_path || E'\\n\\n' || piece AS content
  FROM (FROM pieces WHERE piece <> '') p JOIN (SELECT source, section_ord, heading_path FROM sections) s USING (source, section_ord)
)"""
_CHUNKS = f"{_SECTIONS}, {_CHUNKS_OF_SECTIONS}"
_FILE_CHUNKS = f"{_TITLED_FILES}, {_SECTIONS_OF_TITLED}, {_CHUNKS_OF_SECTIONS}"


def _postings(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_t AS (
  SELECT {key}, unnest(t) AS term, len(t) AS total FROM (SELECT {key}, {_tokens(text)} AS t FROM {source})
), {name}_n AS (SELECT {key}, term, total, count(*) AS n FROM {name}_t GROUP BY ALL
), {name}_ix AS (SELECT term, {_number("term")} AS ix FROM (SELECT DISTINCT term FROM {name}_n)
), {name} AS (SELECT {key}, ix, round(sum(n / total), 12) AS w FROM {name}_n JOIN {name}_ix USING (term) GROUP BY ALL)"""


_SPARSE = f"""{_postings("ds", "doc_id", "text", "documents")}, {_postings("qs", "item_id", "text", "benchmark")}, sparse AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM (
      SELECT item_id AS qid, doc_id, round(sum(qs.w * ds.w) + 1e-12, 9) AS score FROM ds JOIN qs USING (ix) GROUP BY ALL))
  WHERE rk <= 20)"""


def _dense(k: int, least: str) -> str:
    return f"""dense AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM (
      SELECT q.vec_id AS qid, v.vec_id AS doc_id,
        round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
      FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id JOIN embeddings v ON v.vec_id <> q.vec_id) {least})
  WHERE rk <= {k})"""


_FUSED = f"""{_SPARSE}, {_dense(20, "")}, fused AS (
  SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rk AS dense_rk, s.rk AS sparse_rk,
    round(coalesce(1.0::DOUBLE / (60 + s.rk), 0) + coalesce(1.0::DOUBLE / (60 + d.rk), 0), 9) AS rrf
  FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.doc_id = s.doc_id
), hybrid AS (
  SELECT * FROM (
    SELECT qid, doc_id, rrf AS score, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS rk FROM fused)
  WHERE rk <= 5)"""
_LIBRARY = r"""library AS (
  SELECT doc_id, source || '/' || doc_id || '.md' AS source, text AS content,
    coalesce(nullif(regexp_extract(text, '(?m)^#\s+([^\r\n]+)', 1), ''), doc_id::VARCHAR) AS title FROM documents)"""
_CONTEXT = f"""{_FUSED}, {_LIBRARY}, context AS (
  SELECT qid, string_agg(content, E'\\n\\n---\\n\\n' ORDER BY rk) AS context FROM hybrid JOIN library USING (doc_id) GROUP BY qid)"""
_CITED = f"""{_FUSED}, {_LIBRARY}, cited AS (
  SELECT qid, rk, title, source, score, substr(content, 1, 200) || '...' AS excerpt FROM hybrid JOIN library USING (doc_id))"""

SQL: dict[str, str] = {
    "tokenize_terms": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "sparse_tf": f"""WITH t AS (SELECT doc_id, unnest(t) AS term, len(t) AS total FROM (SELECT doc_id, {_tokens("text")} AS t FROM documents))
SELECT doc_id, term, count(*) AS n, round(count(*) / total, 9) AS tf FROM t GROUP BY doc_id, term, total""",
    "term_numbers": f"SELECT term, {_number('term')} AS ix FROM (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM documents)",
    "sparse_vectors": f"WITH {_postings('ds', 'doc_id', 'text', 'documents')} SELECT doc_id, ix, round(w, 9) AS w FROM ds",
    "sparse_topk": f"WITH {_SPARSE} SELECT qid, doc_id, score, rk FROM sparse",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 9) AS norm FROM embeddings",
    "dense_topk": f"WITH {_dense(20, '')} SELECT qid, doc_id, score, rk FROM dense",
    "legacy_cosine_filter": f"WITH {_dense(5, 'WHERE score > 0.6')} SELECT qid, doc_id, score FROM dense",
    "rrf_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "hybrid_topk": f"WITH {_FUSED} SELECT * FROM hybrid",
    "min_score_filter": f"WITH {_FUSED} SELECT qid, doc_id, score FROM hybrid WHERE score >= 0.016",
    "citations": f"WITH {_CITED} SELECT * FROM cited",
    "title_extract": f"WITH {_MARKDOWN} SELECT source, title FROM titled",
    "sections": f"WITH {_SECTIONS} SELECT * FROM sections",
    "chunk_ids": f"WITH {_FILES} SELECT source, {_uuid("source", "coalesce(content, '')")} AS id FROM files",
    "file_hashes": f"WITH {_DIFF} SELECT source, hash FROM cur",
    "diff_deleted": f"WITH {_DIFF} SELECT source FROM prev ANTI JOIN cur USING (source)",
    "diff_todo": f"WITH {_DIFF} SELECT source FROM changed",
    "diff_skipped": f"WITH {_DIFF} SELECT source FROM cur SEMI JOIN prev USING (source, hash)",
    "upsert": f"""WITH {_DIFF}, rows AS (SELECT {_uuid("source", "coalesce(content, '')")} AS id, source, md5(content) AS content FROM files)
SELECT id, source, CASE WHEN source IN (SELECT source FROM changed) THEN 'new:' || content ELSE content END AS content FROM rows""",
    "delete_by_source": f"""WITH {_DIFF}, rows AS (SELECT {_uuid("source", "coalesce(content, '')")} AS id, source, md5(content) AS content FROM files)
SELECT * FROM rows ANTI JOIN changed USING (source)""",
    "dedupe_last_wins": """SELECT id, conv_id, turn, role FROM (
  SELECT md5(coalesce(text, '')) AS id, conv_id, turn, role,
    row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY conv_id DESC, turn DESC) AS n FROM conversations) WHERE n = 1""",
    "history_window": """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6""",
    "context_join": f"WITH {_CONTEXT} SELECT qid, context FROM context",
    "prompt_messages": f"""WITH {_CONTEXT}, told AS (
  SELECT conv_id AS qid, list({{'role': role, 'content': text}} ORDER BY turn) AS history FROM conversations GROUP BY conv_id
), whole AS (
  SELECT item_id AS qid, list_concat([{{'role': 'system', 'content': '{SYSTEM}'}}],
    coalesce(history[greatest(len(history) - 5, 1):], []),
    [{{'role': 'user', 'content': E'Context:\\n\\n' || coalesce(context, '') || E'\\n\\n---\\n\\n' || 'Question: ' || text}}]) AS m
  FROM benchmark LEFT JOIN told ON told.qid = item_id LEFT JOIN context ON context.qid = item_id
)
SELECT qid, seq::INTEGER AS seq, e.role AS role, e.content AS content FROM (
  SELECT qid, unnest(range(len(m))) AS seq, unnest(m) AS e FROM whole)""",
    "sse_frames": f"""WITH {_CITED}, words AS (
  SELECT item_id AS qid, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))
SELECT qid, 0::BIGINT AS seq, 'data: ' || to_json({{'type': 'sources', 'sources': list({{'title': title, 'source': source, 'score': score}} ORDER BY rk)}})::VARCHAR || E'\\n\\n' AS frame
FROM cited GROUP BY qid
UNION ALL SELECT qid, pos + 1, 'data: ' || to_json({{'type': 'token', 'token': token}})::VARCHAR || E'\\n\\n' FROM words
UNION ALL SELECT qid, max(pos) + 2, E'data: [DONE]\\n\\n' FROM words GROUP BY qid""",
    "sse_fold": "SELECT item_id AS qid, text AS answer FROM benchmark",
    "not_found_fallback": f"""WITH {_FUSED}, n AS (SELECT qid, count(*) AS n FROM hybrid WHERE score >= 0.03 GROUP BY qid)
SELECT item_id AS qid, CASE WHEN n IS NULL THEN '{NOT_FOUND}' END AS answer, coalesce(n, 0) AS n_sources
FROM benchmark LEFT JOIN n ON n.qid = item_id""",
}
SQL |= {
    "section_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT source, section_title, chunk_index, content FROM chunks",
    "all_section_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT source, section_title, section_ord, chunk_index, content FROM chunks",
    "chunk_count": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS chunks FROM chunks",
    "embed_batches": f"""WITH RECURSIVE {_CHUNKS} SELECT source, batch_no, count(*) AS n FROM (
  SELECT source, (row_number() OVER (PARTITION BY source ORDER BY section_ord, chunk_index) - 1) // 10 AS batch_no FROM chunks) GROUP BY ALL""",
    "sub_split": f"WITH RECURSIVE {_FILE_CHUNKS} SELECT source, section_title, section_ord, chunk_index, length(content) AS n_chars, content FROM chunks",
    "ingest_metrics": f"""WITH RECURSIVE {_DIFF}, {_FILE_CHUNKS.removeprefix(_FILES + ", ")}
SELECT (SELECT count(*) FROM changed) AS processed,
  (SELECT count(*) FROM cur SEMI JOIN prev USING (source, hash)) AS skipped,
  (SELECT count(*) FROM prev ANTI JOIN cur USING (source)) AS deleted,
  (SELECT count(*) FROM chunks SEMI JOIN changed USING (source)) AS chunks""",
}
_BM25 = f"""{_FILE_CHUNKS}, texts AS (
  SELECT {_uuid("source", "content")} AS id, {_tokens("content")} AS t FROM (SELECT DISTINCT source, content FROM chunks)
), asked_t AS (SELECT item_id AS qid, unnest({_tokens("text")}) AS term FROM benchmark
), words AS (SELECT id, unnest(t) AS term, len(t) AS terms FROM texts
), numbers AS (SELECT term, {_number("term")} AS ix FROM (SELECT term FROM words UNION SELECT term FROM asked_t)
), counted AS (SELECT id, ix, terms, count(*) AS n FROM words JOIN numbers USING (term) GROUP BY ALL
), whole AS (SELECT count(*) AS texts, sum(len(t)) / count(*) AS mean FROM texts
), idf AS (SELECT ix, ln(1 + (texts - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM counted, whole GROUP BY ix, texts
), scored AS (
  SELECT qid, id, round(sum(w * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * terms / mean))) + 1e-12, 9) AS score
  FROM (SELECT DISTINCT qid, ix FROM asked_t JOIN numbers USING (term)) JOIN counted USING (ix) JOIN idf USING (ix), whole GROUP BY qid, id
)"""
_STORED_DENSE = f"""ids AS (SELECT doc_id AS n, {_uuid("source", "coalesce(content, '')")} AS id FROM files
), near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM (
      SELECT q.vec_id AS qid, id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
      FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v JOIN ids ON n = v.vec_id))
  WHERE rk <= 20
), worded AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM (
      SELECT item_id AS qid, id AS doc_id, round(sum(qs.w * ds.w) + 1e-12, 9) AS score FROM ds JOIN qs USING (ix) JOIN ids ON n = ds.doc_id GROUP BY ALL))
  WHERE rk <= 20)"""
SQL |= {
    "bm25_topk": f"""WITH RECURSIVE {_BM25} SELECT * FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM scored) WHERE rk <= 20""",
    "stored_hybrid_topk": f"""WITH {_FILES}, {_SPARSE}, {_STORED_DENSE} SELECT * FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM (
    SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM (SELECT qid, doc_id, rk FROM near UNION ALL SELECT qid, doc_id, rk FROM worded) GROUP BY ALL))
WHERE rk <= 5""",
}
SQL |= {
    "json_store_merge": """WITH said AS (
  SELECT md5(coalesce(text, '')) AS id, conv_id, turn, role, conv_id * 1000 + turn AS position, conv_id % 2 AS half FROM conversations
), placed AS (
  SELECT * REPLACE (position + half * (SELECT coalesce(max(position) + 1, 0) FROM said WHERE half = 0) AS position) FROM said
)
SELECT id, min(position) AS position, arg_max(conv_id, position) AS conv_id, arg_max(turn, position) AS turn, arg_max(role, position) AS role
FROM placed GROUP BY id""",
}
SQL |= {"all_chunk_count": SQL["chunk_count"], "all_embed_batches": SQL["embed_batches"], "changed_chunk_metrics": SQL["ingest_metrics"]}
SQL |= {
    "request_questions": f"""WITH h AS (SELECT conv_id AS qid, list(text ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
SELECT qid, h[1] AS question, len(h) - 1 AS n_history, CASE WHEN len(h) > 1 THEN h[-1] END AS last FROM h
WHERE regexp_replace(coalesce(h[1], ''), '{_SPACE}', '', 'g') <> ''""",
}
SQL |= {
    "stored_topk": SQL["sparse_topk"],
    "cosine_above": f"WITH {_dense(5, 'WHERE score > 0.25').replace('v.vec_id <> q.vec_id', 'true')} SELECT qid, doc_id, score FROM dense",
    "upsert_replacing": SQL["upsert"],
    "ingested": f"""WITH {_FILES} SELECT source, 0::BIGINT AS stale FROM files
WHERE regexp_replace(coalesce(content, ''), '[\\s\\x{{A0}}\\x{{FEFF}}]', '', 'g') <> ''""",
}
