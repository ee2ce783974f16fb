"""DuckDB SQL for the queries of this subpackage that SQL expresses on whole tables."""

from __future__ import annotations

from lamella.llm.chat_format import END, TEXT, TURN

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS s
  FROM words WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o.n >= 80 * (x.n + y.n - o.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT reach.a AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a GROUP BY reach.a"""

TOPK_SEARCH = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM m"""


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || 'e')"
    for control in ("<|", "</s>", "<s>", "<SYS>", "</SYS>", "[INST]", "[/INST]"):
        if control.endswith("SYS>"):
            out = f"replace({out}, '<{control}', '<' || chr(92) || 'p{control}')"
        else:
            out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || 'p{control[1:]}')"
    return out


CHAT_FORMAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

VECTOR_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(counts.n), 0) AS n_links, min(reach.b) AS component_id, vec_id = min(reach.b) AS kept
FROM embeddings JOIN reach ON reach.a = vec_id LEFT JOIN counts ON counts.a = vec_id GROUP BY vec_id"""

ORACLE_SQL = {
    "op1_ngram_join": NGRAM_JOIN,
    "op4_topk_search": TOPK_SEARCH,
    "op5_warc": WARC,
    "op6_chat_format": CHAT_FORMAT,
    "op8_vector_dedup": VECTOR_DEDUP,
}
