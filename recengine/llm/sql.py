"""SQL for DuckDB that gives the rows of those queries that SQL can express, written from the contract alone."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
g AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT doc_id, i, g.m, item_id FROM g JOIN win ON g.t = win.t AND g.m = win.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY ALL),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9 = r"""
WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM a),
m AS (SELECT page_id, arg_max(struct_pack(k := rh || rp, v := v), length(rh || rp)) AS b
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, b.k AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l(i, share) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM w)
  UNION ALL
  SELECT i + 1, (SELECT ((SELECT sum(source_size)::DOUBLE FROM w) - coalesce(sum(most) FILTER (WHERE weight * share > most), 0)) / sum(weight) FILTER (WHERE weight * share <= most) FROM w)
  FROM l WHERE i < 25),
t AS (SELECT w.*, least(weight * (SELECT max(share) FROM l), most) AS target FROM w),
c AS (SELECT *, coalesce(sum(target) OVER (ORDER BY coalesce('s' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(target) FROM t) AS lo,
             sum(target) OVER (ORDER BY coalesce('s' || source, 'n') ROWS UNBOUNDED PRECEDING) / (SELECT sum(target) FROM t) AS hi,
             lead(source_size) OVER (ORDER BY coalesce('s' || source, 'n')) IS NULL AS last FROM t WHERE target > 0),
p AS (SELECT ((x * 1327217885) % 2147483648) / 2147483648.0::DOUBLE AS u FROM range((SELECT ceil(sum(target) / 64)::BIGINT FROM t)) AS r(x)),
n AS (SELECT source, count(*) AS slots FROM p JOIN c ON u >= lo AND (u < hi OR last) GROUP BY source),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d)
SELECT a.doc_id, a.size, t.source_size, t.target,
       (SELECT sum(greatest(0, least(pos + e * t.source_size + a.size, coalesce(slots, 0) * 64) - (pos + e * t.source_size))) FROM range(3) AS r(e))::BIGINT AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON a.source IS NOT DISTINCT FROM n.source
"""

SQL = {"op1_decontaminate": OP1, "op9_url_filter": OP9, "op10_mix_sources": OP10}

OP8 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT t, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN k USING (t)
"""
SQL["op8_exact_dedup"] = OP8

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
SQL["op4_jaccard_groups"] = OP4
