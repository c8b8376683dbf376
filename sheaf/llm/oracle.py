"""The same queries in SQL for an independent engine, where SQL can express them."""

from __future__ import annotations

from sheaf.llm.licenses import COSINE, FILE_NAMES, NOTICES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


URL_FILTER = r"""
WITH cap AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.*(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
hosts AS (
  SELECT host, ('0x' || substr(md5(host), 1, 3))::INT AS a, ('0x' || substr(md5(host), 4, 3))::INT AS b, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain
  FROM (SELECT DISTINCT host FROM cap WHERE host <> '')),
log AS (
  SELECT 'hosts' AS list, host AS pattern, 2 AS act, b % 200 AS d FROM hosts WHERE a % 3 = 0
  UNION ALL SELECT 'hosts', host, 0, b % 200 + 60 FROM hosts WHERE a % 6 = 0
  UNION ALL SELECT 'hosts', host, 2, b % 200 + 150 FROM hosts WHERE a % 12 = 0
  UNION ALL SELECT 'paths', host || '/en', 1, b % 100 FROM hosts WHERE a % 5 = 0
  UNION ALL SELECT 'paths', host || '/de', 2, b % 300 FROM hosts WHERE a % 7 = 0
  UNION ALL SELECT 'domains', domain, 2, 300 + a % 50 FROM hosts WHERE b % 16 = 0),
held AS (
  SELECT * FROM (
    SELECT list, pattern, act, TIMESTAMP '2024-01-01' + to_days(d) AS since,
           lead(TIMESTAMP '2024-01-01' + to_days(d)) OVER (PARTITION BY list, pattern ORDER BY d) AS until
    FROM (SELECT list, pattern, d, max(act) AS act FROM log GROUP BY ALL))
  WHERE act > 0),
keyed AS (
  SELECT page_id, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: {'p': array_to_string(string_split(host, '.')[i:], '.'), 'r': len(string_split(host, '.')) - i + 1}),
    list_transform(range(1, len(segs) + 1), lambda i: {'p': host || '/' || array_to_string(segs[1:i], '/'), 'r': 1000 + i})), recursive := true)
  FROM cap WHERE host <> ''),
best AS (
  SELECT page_id, pattern, act, since FROM keyed JOIN held ON keyed.p = held.pattern AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY r DESC, (act = 2) DESC, since DESC) = 1)
SELECT page_id, url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, nullif(host, '') AS host, coalesce(act = 2, false) AS blocked, pattern,
       strftime(since, '%Y-%m-%d %H:%M:%S') AS listed_at
FROM cap LEFT JOIN best USING (page_id)
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
least AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

_TERMS = r"regexp_extract_all(lower({0}), '[a-z\p{{L}}]+|[0-9]+(?:\.[0-9]+)*')"

LICENSES = f"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN source || '/LICENSE'
    WHEN doc_id % 100 = 0 THEN source || '/d' || (doc_id % 1000 // 100) || '/LICENSE'
    ELSE source || '/d' || (doc_id % 1000 // 100) || '/' || doc_id || '.txt' END AS path
  FROM documents),
named AS (SELECT *, regexp_matches(regexp_extract(path, '([^/]*)$', 1), {lit(FILE_NAMES)}) AS governs, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
notice(license_id, text) AS (VALUES {", ".join(f"({lit(k)}, {lit(t)})" for k, ts in NOTICES.items() for t in ts)}),
tpl AS (SELECT license_id, row_number() OVER () AS t, {_TERMS.format("text")} AS ts FROM notice),
vocab AS (SELECT DISTINCT unnest(ts) AS w FROM tpl),
lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM files),
total AS (SELECT count(*) AS n FROM lines),
df AS (SELECT w, count(*) AS c FROM (SELECT unnest(list_distinct({_TERMS.format("line")})) AS w FROM lines) GROUP BY 1),
idf AS (SELECT w, ln((n + 1) / (coalesce(c, 0) + 1)) + 1 AS v FROM (SELECT w FROM vocab UNION SELECT w FROM df) LEFT JOIN df USING (w) CROSS JOIN total),
units AS (SELECT row_number() OVER () AS u, * FROM (
  SELECT doc_id, {_TERMS.format("line")} AS ts FROM lines UNION ALL SELECT doc_id, {_TERMS.format("text")} FROM named WHERE governs)),
counted AS (SELECT u, w, count(*) AS k FROM (SELECT u, unnest(ts) AS w FROM units) GROUP BY ALL),
weighed AS (SELECT u, w, k, v FROM counted LEFT JOIN idf USING (w)),
norms AS (SELECT u, sum(k * v * k * v) AS norm FROM weighed GROUP BY u),
tw AS (SELECT t, license_id, w, count(*) * any_value(v) AS tw FROM (SELECT t, license_id, unnest(ts) AS w FROM tpl) JOIN idf USING (w) GROUP BY ALL),
tn AS (SELECT t, sum(tw * tw) AS tnorm FROM tw GROUP BY 1),
dots AS (SELECT u, t, license_id, sum(k * v * tw) AS dot FROM weighed JOIN tw USING (w) GROUP BY ALL),
scored AS (SELECT doc_id, license_id, round(dot / sqrt(norm * tnorm), 9) AS score FROM dots JOIN norms USING (u) JOIN tn USING (t) JOIN units USING (u)),
own AS (SELECT doc_id, license_id, score FROM scored WHERE score >= {COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license_id) = 1),
gov AS (SELECT dir, license_id FROM own JOIN named USING (doc_id) WHERE governs QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license_id) = 1),
up AS (
  SELECT doc_id, gov.dir, gov.license_id FROM named JOIN gov ON named.dir = gov.dir OR starts_with(named.dir, gov.dir || '/') OR gov.dir = ''
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(gov.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.license_id, up.license_id) AS license_id,
  CASE WHEN own.license_id IS NOT NULL THEN 'header' WHEN up.license_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.license_id IS NULL THEN up.dir END AS source_dir, round(score, 6) AS score
FROM named LEFT JOIN own USING (doc_id) LEFT JOIN up USING (doc_id)
"""

PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))
         ), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
),
chosen AS (
  SELECT c.conv_id, 0 AS part, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.n < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.n >= c.h
),
rebuilt AS (
  SELECT conv_id, text, row_number() OVER w AS depth,
         string_agg(sha256(role) || sha256(text), ',') OVER w AS path
  FROM chosen WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
),
paths AS (
  SELECT conv_id, 0 AS depth, 'root' AS node, 0 AS words FROM convs
  UNION ALL
  SELECT conv_id, depth, sha256(path), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM rebuilt
),
members AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends
  FROM paths
),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node
),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
-- a node belongs to its smallest member, so the nodes below another are those of its members from its depth on
totals AS (
  SELECT m.node, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum(u.own) AS saved_tokens
  FROM members m JOIN nodes u ON u.conv_id = m.conv_id AND u.depth >= m.depth LEFT JOIN children c ON c.node = u.node
  GROUP BY m.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN totals t ON t.node = n.node
"""

ORACLE: dict[str, str] = {
    "op1_url_filter": URL_FILTER,
    "op8_grid_order_join": VECTORS,
    "op10_license_scan": LICENSES,
    "op12_prefix_trie": PREFIX_TRIE,
}
