"""DuckDB SQL for the queries whose results SQL can express."""

_COMPONENTS = """
links2 AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT id AS node, id AS other FROM ids
  UNION
  SELECT r.node, l.b FROM reach r JOIN links2 l ON l.a = r.other
),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""

OP1 = f"""
WITH RECURSIVE
v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM n p JOIN n q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e)
  WHERE list_inner_product(p.e, q.e) / (p.norm * q.norm) >= 0.95
),
ids AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS},
degree AS (SELECT a, count(*) AS k FROM links2 GROUP BY a)
SELECT e.vec_id, coalesce(d.k, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP3 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
  FROM w, unnest(range(1, greatest(len(words) - 33, 1))) AS t(i)
),
hot AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + j AS at
  FROM starts JOIN hot USING (win), unnest(range(0, 35)) AS t(j)
),
each AS (SELECT doc_id, i AS at, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
per AS (
  SELECT e.doc_id, count(g.at) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.at) FILTER (WHERE g.at IS NULL), '') AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(p.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(p.kept, '')) AS kept_sha256
FROM w LEFT JOIN per p ON p.doc_id = w.doc_id
"""

OP4 = rf"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0
),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id < q.doc_id GROUP BY ALL
),
links AS (
  SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.k + y.k - c.k)
),
ids AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""


_KEPT = """
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""


def _assign(n: int) -> str:
    """Each part's nearest of the entries b{n}, ties to the lower index: a distance times 64 and the index are one number."""
    return f"""
d{n} AS (
  SELECT x.vec_id, x.p, b.j, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d
  FROM x JOIN b{n} b ON b.p = x.p AND b.i = x.i GROUP BY ALL
),
a{n} AS (SELECT vec_id, p, min(d * 64 + j) % 64 AS j, min(d * 64 + j) // 64 AS d FROM d{n} GROUP BY ALL)"""


def _update(n: int) -> str:
    return f"""
m{n} AS (SELECT a.p, a.j, x.i, sum(x.c)::BIGINT AS s, count(*) AS n FROM a{n} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL),
b{n + 1} AS (
  SELECT b.p, b.j, b.i, CASE WHEN m.n IS NULL THEN b.c ELSE (m.s - (m.s % m.n + m.n) % m.n) // m.n END AS c
  FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.j = b.j AND m.i = b.i
)"""


OP12 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e, len(embedding) // 16 AS w {_KEPT}),
x AS (SELECT vec_id, k // w AS p, k % w AS i, e[k + 1] AS c FROM v, unnest(range(0, len(e))) AS t(k)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v),
b0 AS (SELECT x.p, s.j, x.i, x.c FROM x JOIN s ON s.vec_id = x.vec_id AND s.j < 64),
{_assign(0)},
{_update(0)},
{_assign(1)},
{_update(1)},
{_assign(2)},
e AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT e.vec_id, e.code, e.error, sum(e.error) OVER (PARTITION BY v.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, j, i)) FROM b2) AS codebooks_sha256
FROM e JOIN v ON v.vec_id = e.vec_id
"""

OP13 = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e {_KEPT} AND label IS NOT NULL
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1, "op3_substring_dedup": OP3, "op4_minhash_near_dedup": OP4, "op10_warc_transactions": OP10, "op12_vector_codes": OP12, "op13_hard_negatives": OP13}
