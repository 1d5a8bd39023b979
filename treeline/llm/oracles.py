"""DuckDB SQL for the corpus queries that SQL can express.

Sharding, the source mix, language identification, the classifier, BPE and personal data have
none: they iterate, learn or need positions of matches; tests hold them against brute force.
"""

from __future__ import annotations

from .url_filters import HOST_RULES, PATTERNS, expression

_URL = """
WITH u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
"""


def _op3() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
    loose = "CASE " + " ".join(f"WHEN regexp_matches(host || path, '{expression(p)}') THEN '{p}'" for p in sorted(PATTERNS)) + " END"
    return _URL + f"""
r(rh, rp, v) AS (VALUES {rules}),
f AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {loose} IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN {loose} END AS pattern_rule FROM f
"""


_OP6 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_OP9 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gs FROM w),
g AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS x FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
k AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.v, k.c FROM k JOIN l ON l.u = k.id),
o AS (SELECT id, min(c) AS component_id FROM k GROUP BY id),
y AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(gs) = 0 THEN [doc_id::VARCHAR, ''] ELSE list_sort(gs) END) AS class_id FROM s)
SELECT s.doc_id, len(s.gs)::BIGINT AS n_shingles, o.component_id, y.class_id FROM s JOIN o ON o.id = s.doc_id JOIN y ON y.doc_id = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": _op3(), "op6_exact_dedup": _OP6, "op9_ann": _OP9, "op10_ngram_jaccard": _OP10}
