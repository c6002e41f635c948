"""SQL for the queries that SQL can express in full; the others are tested by brute force."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAME = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT doc_id, {_NAME.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
i AS (SELECT item_id, {_NAME.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(list_slice(ws, k, k + least(13, len(ws)) - 1), ' ') AS t FROM i, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) u(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM w),
dw AS (SELECT doc_id, m, p, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS t FROM d, sizes, unnest(range(1, len(ws) - CAST(m AS INTEGER) + 2)) u(p) WHERE len(ws) >= m),
hit AS (SELECT DISTINCT doc_id, p, dw.m, item_id FROM dw JOIN w ON w.m = dw.m AND w.t = dw.t),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM hit, unnest(range(p, p + m)) u(x) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP10 = r"""
WITH l AS (SELECT doc_id, u.pos, string_split(text, chr(10))[u.pos] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos) WHERE text IS NOT NULL),
lw AS (SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
o AS (SELECT *, (doc_id, pos) AS ord FROM lw WHERE len(ws) > 0),
f AS (SELECT ws, min(ord) AS ord, count(*) AS n FROM o GROUP BY 1),
v AS (SELECT ws, ord, i, list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, len(ws))) AS rest FROM f, unnest(range(1, len(ws) + 1)) u(i) WHERE len(ws) >= 5),
hub AS (SELECT rest, i, min(ord) AS ord FROM v GROUP BY 1, 2),
near AS (SELECT v.ws FROM v JOIN hub USING (rest, i) WHERE v.ord > hub.ord
 UNION SELECT CASE WHEN v.ord > f.ord THEN v.ws ELSE f.ws END FROM v JOIN f ON v.rest = f.ws WHERE len(f.ws) >= 5),
gone AS (SELECT o.doc_id, o.pos FROM o JOIN f USING (ws) LEFT JOIN (SELECT DISTINCT ws, true AS near FROM near) n USING (ws) WHERE near OR o.ord <> f.ord),
kept AS (SELECT lw.doc_id, string_agg(line, chr(10) ORDER BY lw.pos) FILTER (g.pos IS NULL) AS text, count(*) FILTER (len(ws) > 0) AS n_lines, count(g.pos) AS n_gone FROM lw LEFT JOIN gone g ON g.doc_id = lw.doc_id AND g.pos = lw.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, CASE WHEN coalesce(n_gone, 0) = 0 THEN d.text ELSE coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept USING (doc_id)"""


def _lloyd(rounds: int) -> str:
    """Four rounds unrolled; a{r} holds the parts' entries in round r, b{r} the codebooks that they are found in."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT p.id, p.part, b.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j]))) AS d FROM p JOIN b{r} b USING (part)),
a{r} AS MATERIALIZED (SELECT id, part, min([d, e]) AS best FROM d{r} GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT part, best[2] AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN p USING (id, part), unnest(range(1, len(x) + 1)) u(j) GROUP BY 1, 2, 3),
m{r} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{r} GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, e))""")
    return ",".join(steps)


OP11 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS x FROM k, unnest(range(4)) u(part)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS e, x FROM p WHERE id <= 256),{_lloyd(4)},
c AS (SELECT id, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a4 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(x[j] AS VARCHAR), ',' ORDER BY part, e, j)) FROM b4, unnest(range(1, len(x) + 1)) u(j)) AS codebooks_sha256
FROM k JOIN c USING (id)"""

OP13 = """
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
h AS (SELECT conv_id, max(pos) AS total FROM o GROUP BY 1),
k AS (SELECT conv_id, total, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM h, tab),
turns AS (SELECT o.conv_id, 1 AS own, pos, said FROM o JOIN k USING (conv_id) WHERE pos > h UNION ALL SELECT k.conv_id, 0, pos, said FROM k JOIN o ON o.conv_id = k.conv_id - k.conv_id % 100 AND pos <= h),
b AS (SELECT conv_id, coalesce(chain, []) AS chain FROM k LEFT JOIN (SELECT conv_id, list(said ORDER BY own, pos) AS chain FROM turns GROUP BY 1) USING (conv_id)),
n AS (SELECT list_slice(chain, 1, d) AS p, d, min(conv_id) AS c, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(chain) = d) AS ends FROM b, unnest(range(len(chain) + 1)) u(d) GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (p)),
sums AS (SELECT list_slice(p, 1, x) AS p, count_if(kids = 0) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].text) END) AS saved FROM m, unnest(range(d + 1)) u(x) GROUP BY 1)
SELECT m.c AS conv_id, m.d AS depth, q.c AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN sums USING (p) LEFT JOIN m q ON m.d > 0 AND q.p = list_slice(m.p, 1, m.d - 1)"""
