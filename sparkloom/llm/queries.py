"""Queries of this subpackage and the SQL that some of them can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import byte_bpe, filter_audit, fingerprint, hard_negatives, language, near_dedup, online_mixing, packing, page_text, personal_data, secrets, token_orc, vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_orc": token_orc.op1_token_orc,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_language": language.op4_language,
        "op5_packing": packing.op5_packing,
        "op6_secrets": secrets.op6_secrets,
        "op7_page_text": page_text.op7_page_text,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_mixing": online_mixing.op9_mixing,
        "op10_vector_dedup": vector_dedup.op10_vector_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_personal_data": personal_data.op13_personal_data,
    }


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

_NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w), 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN ways e ON r.other = e.a)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.other)::BIGINT AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

_VECTOR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN linked l ON r.other = l.a),
n AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(r.other)::BIGINT AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r ON r.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id
"""


_HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same AND other_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

_FILTER_AUDIT = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < w.doc_id, false)} AS f
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
docs AS (SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM flags GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (SELECT d.*, o.filter_order, coalesce(list_min(list_transform(string_split(d.fails, ''), lambda x: CASE WHEN x <> '' THEN instr(o.filter_order, x) END)), 6) AS out_at FROM docs d, orders o),
steps AS (SELECT part, filter_order, step, substr(filter_order, step::BIGINT, 1) AS x,
  sum(CASE WHEN out_at > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN out_at = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN out_at < step AND contains(fails, substr(filter_order, step::BIGINT, 1)) THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = substr(filter_order, step::BIGINT, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN out_at = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN out_at = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM steps
"""


def oracle_sql() -> dict[str, str]:
    """The other operators rest on tokenizer libraries, hashes or fitted models; tests hold them against brute force instead."""
    return {"op3_near_dedup": _NEAR_DEDUP, "op10_vector_dedup": _VECTOR_DEDUP, "op11_filter_audit": _FILTER_AUDIT, "op12_hard_negatives": _HARD_NEGATIVES}
