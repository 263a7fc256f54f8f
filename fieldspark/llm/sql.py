"""SQL that says the same as a query, for DuckDB over the same tables."""

from __future__ import annotations

AFTER = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
HOST = "coalesce(translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"

NAMED = rf"""
WITH cut AS (SELECT page_id, html, {AFTER} AS after FROM pages),
parts AS (
  SELECT page_id, html, {HOST} AS host, coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(after, '^[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS args
  FROM cut),
named AS (
  SELECT page_id, html, host, path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN args <> '' THEN '?' || args ELSE '' END END AS canonical
  FROM parts),
"""

URL_FILTER = NAMED + """
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fitting AS (
  SELECT n.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY 1),
listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE canonical IS NOT NULL AND 100 * length(regexp_replace(html, '[^#*$%|]', '', 'g')) >= 2 * length(html))
SELECT n.page_id, n.host, n.path, n.canonical, f.rule, f.rule IS NULL AND l.canonical IS NOT NULL AS listed,
  coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fitting f USING (page_id) LEFT JOIN listed l ON l.canonical = n.canonical
"""

JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM worded),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = s.doc_id
"""

EMBEDDINGS = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT r.x AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM reach r LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = r.x GROUP BY r.x
"""

WARC = (
    NAMED
    + r"""
records AS (
  SELECT 3 * page_id + k AS record_id, canonical, make_timestamp((1704067200 + 60 * page_id + [0, 3600, 86400][k + 1]) * 1000000) AS ts, k,
    CASE WHEN k = 2 AND length(html) % 2 = 1 THEN md5(coalesce(html, '')) || '-2' ELSE md5(coalesce(html, '')) END AS tag,
    length(html)::VARCHAR AS size, sha256(html) AS sha
  FROM named, (VALUES (0), (1), (2)) AS ks(k)),
met AS (
  SELECT r.*, f.record_id AS source, f.tag AS old_tag, f.size AS old_size, f.sha AS old_sha
  FROM (SELECT * FROM records WHERE k > 0) r
  LEFT JOIN (SELECT * FROM records WHERE k = 0 AND canonical IS NOT NULL) f ON f.record_id = (
    SELECT arg_max(x.record_id, (x.ts, x.record_id)) FROM records x WHERE x.k = 0 AND x.canonical = r.canonical AND x.ts < r.ts)),
judged AS (SELECT *, source IS NOT NULL AND tag = old_tag AS ok FROM met)
SELECT record_id, canonical, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, source,
  CASE WHEN source IS NULL THEN 'no earlier response' WHEN ok THEN 'resolved' ELSE 'changed' END AS outcome,
  'cache-control: max-age=' || (600 * (k + 1)) || chr(10) || 'content-length: ' || CASE WHEN ok THEN old_size ELSE '0' END || chr(10)
    || 'date: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || CASE WHEN k = 2 THEN 'W/' ELSE '' END || tag AS headers,
  CASE WHEN ok THEN old_sha END AS body_sha256
FROM judged
"""
)

CONVERSATIONS = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS h
  FROM named),
kept AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, generate_series(1, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') AS c, row_number() OVER w AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare,
    lag(role) OVER w AS before
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
edits(old, letter, initial, new, cost) AS (
  SELECT s, 'D', '', s, 2 FROM (VALUES (0), (1), (2), (3)) AS t(s)
  UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
    (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (2, 'R', '', 3, 1), (3, 'R', '', 2, 1)),
-- An insertion (5) is never among the cheapest edits: deleting a neighbour of the same role, or the last user, costs 2.
ways AS (
  SELECT c, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM (SELECT DISTINCT c FROM judged)
  UNION ALL
  SELECT c, i, state, min(best) AS best FROM (
    SELECT w.c, w.i + 1 AS i, e.new AS state, {'cost': (w.best).cost + e.cost + CASE WHEN j.fault = 't' AND e.letter <> 'D' THEN 5 ELSE 0 END, 'audit': (w.best).audit || e.letter} AS best
    FROM ways w JOIN judged j ON j.c = w.c AND j.i = w.i + 1 JOIN edits e ON e.old = w.state
    WHERE e.letter = 'D' OR (j.fault NOT IN ('b', 'd') AND (e.letter = 'R' OR e.initial = j.role[1]))) GROUP BY c, i, state),
chosen AS (
  SELECT w.c, min(w.best) AS best FROM ways w JOIN (SELECT c, max(i) AS n FROM judged GROUP BY c) l ON l.c = w.c AND l.n = w.i
  WHERE w.state IN (0, 3) GROUP BY w.c),
lines AS (
  SELECT j.c, j.i, (b.best).audit[j.i] AS letter, j.role, j.text,
    row_number() OVER (PARTITION BY j.c ORDER BY j.i) - max(CASE WHEN (b.best).audit[j.i] = 'K' AND j.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY j.c) AS nth
  FROM judged j JOIN chosen b ON b.c = j.c WHERE (b.best).audit[j.i] <> 'D'),
hashed AS (
  SELECT c, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS sha FROM lines GROUP BY c),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce((best).cost, 0)::BIGINT AS cost, coalesce((best).audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations) o
LEFT JOIN counted USING (c) LEFT JOIN chosen USING (c) LEFT JOIN hashed USING (c)
"""

TOP_PRODUCTS = r"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows q JOIN rows x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"

RANKED = f"""
WITH sized AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
whole AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM sized WHERE len(t) > 0),
counts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), whole WHERE doc_id IS NOT NULL GROUP BY item_id, r HAVING score > 0)
SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM scored
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10
"""
