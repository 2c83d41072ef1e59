"""DuckDB SQL for those corpus queries that it can express: plain statements of the contracts, without any candidate search."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)"""

REPEATS = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS p, b FROM b),
g AS (SELECT doc_id, p, array_slice(b, p, p + 49) AS g FROM p WHERE p + 49 <= octet_length(b)),
m AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM g JOIN m USING (g) WHERE d < doc_id),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (NOT follows) AS n_spans FROM (SELECT doc_id, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) = p - 1, false) AS follows FROM c) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(hex(array_slice(b, p, p)), '' ORDER BY p) AS h FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT b.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM b LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"""

CONTAMINATION = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT id, k, list_slice(w, i, i + k - 1) AS win FROM (SELECT id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
pos AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, i, k, id FROM pos JOIN win USING (k, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
