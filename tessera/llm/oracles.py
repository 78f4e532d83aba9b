"""SQL (DuckDB's dialect) that gives the rows of the queries which SQL can express."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(" + _LOW.format("text") + r", '[^\x20\x09-\x0D]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS y FROM d, unnest(range(1, len(w) + 1)) r(i)),
n AS (SELECT count(*) AS total FROM t),
c1 AS (SELECT x, count(*) AS c FROM t GROUP BY 1), o1 AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY ALL),
c2 AS (SELECT y, x, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY ALL), o2 AS (SELECT doc_id, y, x, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY ALL),
l AS (SELECT doc_id, len(w) AS n_words FROM d),
u AS (SELECT o1.doc_id, o1.x, c1.c - o1.c AS k, greatest(total - n_words, 1)::DOUBLE AS rest FROM o1 JOIN c1 USING (x) JOIN l USING (doc_id), n),
b AS (SELECT o2.doc_id, o2.y, o2.x, c2.c - o2.c AS k, o2.c AS times FROM o2 JOIN c2 USING (y, x)),
s AS (
  SELECT b.doc_id, times * CASE WHEN b.k > 0 THEN ln(b.k::DOUBLE / p.k) ELSE ln((CASE WHEN q.k > 0 THEN q.k::DOUBLE ELSE 1 / q.rest END) / q.rest) + ln(0.4::DOUBLE) END AS v, CASE WHEN b.k > 0 THEN 0 ELSE times END AS missed
  FROM b JOIN u p ON p.doc_id = b.doc_id AND p.x = b.y JOIN u q ON q.doc_id = b.doc_id AND q.x = b.x
  UNION ALL
  SELECT t.doc_id, ln((CASE WHEN u.k > 0 THEN u.k::DOUBLE ELSE 1 / u.rest END) / u.rest), 0 FROM t JOIN u USING (doc_id, x) WHERE i = 1),
g AS (SELECT doc_id, sum(v) AS v, sum(missed) AS missed FROM s GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, round(coalesce(v, 0), 6) AS log_score, round(v / n_words, 6) AS mean_log, CAST(coalesce(missed, 0) AS BIGINT) AS n_backoff FROM l LEFT JOIN g USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS}, []) AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) r(i)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) r(i)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) r(p) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
-- proximity: an item's three rarest words; each place of the rarest with the narrowest stretch around it of under 20 words
t AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) r(i)),
f AS (SELECT x, count(*) AS freq FROM t GROUP BY 1),
bt AS (SELECT DISTINCT item, x FROM (SELECT item, unnest(w) AS x FROM b WHERE item IS NOT NULL)),
rare AS (SELECT item, x, row_number() OVER (PARTITION BY item ORDER BY freq, x) AS place FROM bt JOIN f USING (x) QUALIFY place <= 3),
size AS (SELECT item, count(*) AS k FROM rare GROUP BY 1),
p AS (SELECT doc_id, item, place, i FROM t JOIN rare USING (x)),
near AS (SELECT a.doc_id, a.item, a.i AS spot, e.i, e.place FROM p a JOIN p e ON e.doc_id = a.doc_id AND e.item = a.item AND abs(e.i - a.i) < 20 AND (e.place > 1 OR e.i = a.i) WHERE a.place = 1),
ends AS (SELECT s.doc_id, s.item, s.spot, s.i AS begin_at, e.place, min(e.i) AS i FROM near s JOIN near e ON e.doc_id = s.doc_id AND e.item = s.item AND e.spot = s.spot AND e.i >= s.i WHERE s.i <= s.spot GROUP BY ALL),
fits AS (SELECT doc_id, item, spot FROM (SELECT doc_id, item, spot, begin_at, count(*) AS c, max(i) - min(i) AS width FROM ends GROUP BY ALL) JOIN size USING (item) WHERE c = k AND width < 20 GROUP BY ALL),
prox AS (SELECT doc_id, count(*) AS n_near FROM fits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN prox USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM d, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) r(i)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS df FROM s GROUP BY 1),
-- pairs at this similarity share one of the rarest k - ceil(0.8 k) + 1 shingles of each
r AS (SELECT s.doc_id, s.g, k, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.g) AS place FROM s JOIN f USING (g) JOIN n USING (doc_id)),
x AS (SELECT * FROM r WHERE place <= k - (80 * k + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v, a.k AS ku, b.k AS kv FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.k, b.k) >= 80 * greatest(a.k, b.k)),
link AS (SELECT u, v FROM cand JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v AND b.g = a.g GROUP BY u, v, ku, kv HAVING 100 * count(*) >= 80 * (ku + kv - count(*))),
dual AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT a, v FROM reach JOIN dual ON z = u),
comp AS (SELECT a AS doc_id, min(z) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

SQL = {"op4_stupid_backoff": OP4, "op6_benchmark_phrases": OP6, "op8_near_duplicates": OP8}
