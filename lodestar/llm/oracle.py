"""DuckDB SQL of the operators whose whole result SQL can express."""

from __future__ import annotations

#: Links by prefix filtering, which loses none: two sets that share 85 % of their union share a shingle among the rarest n - ceil(0.85 n) + 1 of each. Equal sets are one class; copies count as links.
_LINKS = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
row_class AS (SELECT r, doc_id, len(sh) AS n, sha256(array_to_string(list_sort(sh), chr(10))) AS cls, sh FROM s),
class AS (SELECT cls, any_value(n) AS n, any_value(list_sort(sh)) AS sh, count(*) AS copies, min(doc_id) AS least FROM row_class WHERE n > 0 GROUP BY cls),
item AS (SELECT cls, n, unnest(sh) AS x FROM class),
frequency AS (SELECT x, count(*) AS df FROM item GROUP BY x),
prefix AS (SELECT cls, n, x FROM item JOIN frequency USING (x) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY df, x) <= n - (85 * n + 99) // 100 + 1),
candidate AS (SELECT DISTINCT a.cls AS a, b.cls AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (SELECT c.a, c.b, p.n AS na, q.n AS nb, len(list_intersect(p.sh, q.sh)) AS m FROM candidate c JOIN class p ON p.cls = c.a JOIN class q ON q.cls = c.b),
pair AS (SELECT a, b FROM shared WHERE 100 * m >= 85 * (na + nb - m)),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT cls AS a, cls AS b FROM class UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
component AS (SELECT a AS cls, min(least) AS component_id FROM reach JOIN class ON class.cls = reach.b GROUP BY 1),
linked AS (SELECT a AS cls, sum(copies) AS others FROM edge JOIN class ON class.cls = edge.b GROUP BY 1)
SELECT doc_id, row_class.n AS n_shingles, coalesce(component_id, doc_id) AS component_id, (CASE WHEN row_class.n = 0 THEN 0 ELSE copies - 1 + coalesce(others, 0) END)::BIGINT AS n_links
FROM row_class LEFT JOIN class USING (cls) LEFT JOIN component USING (cls) LEFT JOIN linked USING (cls)
"""

#: SHA-1 in hex to base32: twenty bits, five digits, become four letters.
_ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM x
"""

ORACLE = {"op4_ngram_jaccard": _LINKS, "op6_warc": _ARCHIVE}
