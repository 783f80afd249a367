"""DuckDB statements for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from orarium.llm.fair_mix import ORACLE as FAIR_MIX

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
strings AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM strings),
places AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d CROSS JOIN lengths WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, m, p FROM places JOIN strings USING (m, s)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u),
least_one AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least_one LEFT JOIN sizes USING (doc_id)
"""

KD_FILTER = """
WITH RECURSIVE kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(x::DOUBLE) < 1048576)) = 64),
first AS (SELECT v, row_number() OVER (ORDER BY h, v) - 1 AS cluster FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT 16),
rounds(nth, cluster, c) AS (
  SELECT 0, cluster, v FROM first
  UNION ALL
  (WITH now AS (SELECT * FROM rounds),
  near AS (SELECT r, v, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT r, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN now) GROUP BY r, v),
  sums AS (SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS d FROM near) GROUP BY cluster, d),
  means AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM sums GROUP BY cluster)
  SELECT now.nth + 1, now.cluster, coalesce(means.c, now.c) FROM now LEFT JOIN means USING (cluster) WHERE now.nth < 3)),
final AS (SELECT cluster, c, sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256 FROM rounds WHERE nth = 3),
near AS (SELECT r, vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d)::BIGINT AS distance FROM (SELECT r, vec_id, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN final) GROUP BY r, vec_id)
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near JOIN final USING (cluster)
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents) GROUP BY doc_id, w),
codes AS (SELECT w, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM runs),
hashed AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM codes CROSS JOIN tab),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shapes AS (SELECT word, n, unnest(list_transform(range(len(word)), lambda i: word[:i] || '*' || word[i + 2:])) AS replaced FROM words),
shorter AS (SELECT DISTINCT word, n, unnest(list_transform(range(len(word)), lambda i: word[:i] || word[i + 2:])) AS cut FROM words),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM shapes a JOIN shapes b USING (replaced) WHERE a.word <> b.word
  UNION ALL SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.cut = w.word
  UNION ALL SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.cut = w.word),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 2 * n),
onward(word, root) AS (SELECT word, form FROM forms UNION ALL SELECT o.word, f.form FROM onward o JOIN forms f ON o.root = f.word),
roots AS (SELECT word, root FROM onward WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words w LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""

ORACLE_SQL = {"op3_decontamination": DECONTAMINATION, "op9_bbit_minhash": NEAR_DUPLICATES, "op10_fair_mix": FAIR_MIX, "op12_kd_filter": KD_FILTER, "op13_spelling_variants": SPELLING_VARIANTS}
