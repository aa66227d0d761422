"""The SQL that results must equal, for the operators that SQL can express."""

from . import clusters
from .packing import BUCKETS, BUDGET, MAX_LEN

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PACKING = f"""
WITH RECURSIVE lengths AS (SELECT doc_id, len({WORDS}) + 1 AS n FROM documents),
parts AS (
  SELECT doc_id, c AS chunk, least({MAX_LEN}, n - c * {MAX_LEN}) AS length
  FROM (SELECT doc_id, n, unnest(range((n + {MAX_LEN - 1}) // {MAX_LEN})) AS c FROM lengths)
),
hist AS (
  SELECT length, row_number() OVER (ORDER BY length) AS j, sum(count(*)) OVER (ORDER BY length) AS cum,
    sum(sum(length)) OVER (ORDER BY length) AS tok
  FROM parts GROUP BY length
),
points AS (SELECT 0::BIGINT AS j, 0::BIGINT AS length, 0::HUGEINT AS cum, 0::HUGEINT AS tok
  UNION ALL SELECT j, length, cum, tok FROM hist),
-- The least padding of the first j lengths in k buckets, and the ends of these buckets.
best AS (
  SELECT 1 AS k, j, length * cum - tok AS cost, [length] AS ends FROM points WHERE j >= 1
  UNION ALL
  SELECT k + 1, j, min(cost), arg_min(ends, cost * 1000000 + i)
  FROM (
    SELECT b.k, p.j, b.j AS i, b.cost + p.length * (p.cum - q.cum) - (p.tok - q.tok) AS cost,
      list_append(b.ends, p.length) AS ends
    FROM best b JOIN points q ON q.j = b.j JOIN points p ON p.j > b.j AND p.j > b.k WHERE b.k < {BUCKETS}
  ) GROUP BY k, j
),
chosen AS (SELECT unnest(ends) AS e FROM (
  SELECT ends FROM best WHERE j = (SELECT max(j) FROM hist) ORDER BY k DESC LIMIT 1)),
placed AS (SELECT doc_id, chunk, length, (SELECT min(e) FROM chosen WHERE e >= length) AS b FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id, chunk) - 1 AS r FROM placed)
SELECT doc_id, chunk::INT AS chunk, length::INT AS length, b::INT AS bucket_len,
  (r // greatest(1, {BUDGET} // b))::BIGINT AS batch, (r % greatest(1, {BUDGET} // b))::INT AS slot
FROM ranked
"""

TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUALITY = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
),
starts AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM starts) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)
),
judged AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (n_symbols > 2 * n_words)::BIGINT + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  failed = 0 AS kept, failed::BIGINT AS failed_rules
FROM judged
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
classes AS (
  SELECT min(doc_id) AS rep, list(doc_id) AS ids FROM (
    SELECT doc_id, list(s ORDER BY s) AS set FROM shingles GROUP BY doc_id) GROUP BY set
),
own AS (SELECT rep, unnest(ids) AS doc_id FROM classes),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM classes) AND b.doc_id IN (SELECT rep FROM classes) GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
),
part AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id,
  d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN part USING (rep)
"""

LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM split)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
judged AS (SELECT k.*, coalesce(k.doc_id <> first, false) AS gone FROM keyed k LEFT JOIN shared USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

FILL_IN_MIDDLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents
),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM docs
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
      THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _clusters(count: int, dimensions: int, rounds: int, scale: int, seed: int) -> str:
    """Every round as a table of distances, of nearest centroids, and of moved centroids."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE len(embedding) = {dimensions} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, e AS c FROM v
  ORDER BY sha256('{seed}:' || vec_id) LIMIT {count}
)""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT r, cluster, list_sum([(e[i] - c[i]) * (e[i] - c[i]) FOR i IN range(1, {dimensions + 1})])::BIGINT AS d
    FROM v, c{k}) GROUP BY r
)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT cluster, unnest(e) AS x, unnest(range(1, {dimensions + 1})) AS i FROM v JOIN a{k} USING (r)) GROUP BY cluster, i
)""")
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{k} GROUP BY cluster) USING (cluster)
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} f ON f.cluster = a.cluster
"""


CLUSTERS = _clusters(clusters.CENTROIDS, clusters.DIMENSIONS, clusters.ROUNDS, clusters.SCALE, clusters.SEED)

ORACLE_SQL = {
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op1_packing": PACKING,
    "op4_topk": TOPK,
    "op10_quality": QUALITY,
    "op11_line_dedup": LINE_DEDUP,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_clusters": CLUSTERS,
}
