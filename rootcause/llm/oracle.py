"""DuckDB SQL for the corpus queries that SQL can express, by brute force."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
             FROM d JOIN (SELECT DISTINCT n FROM iw) s ON len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n, dw.win FROM dw SEMI JOIN iw ON iw.win = dw.win AND iw.n = dw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits JOIN iw ON iw.win = hits.win AND iw.n = hits.n)
          GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_NOT_SPACE}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.c)
SELECT reach.doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.c),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(max(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM reach LEFT JOIN n ON n.x = reach.vec_id GROUP BY vec_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN first ON first.s = win.s WHERE f < doc_id),
placed AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM placed ANTI JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# Windows are cut from pieces of 256 starts, so that no step walks a whole text for each of them,
# and are compared by 128 bits of MD5; what is removed is kept as spans, never as a row for a byte.
OP9 = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, CAST(strlen(hex(coalesce(text, ''))) // 2 AS BIGINT) AS n FROM documents),
piece AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * (256 + 99)) AS p
          FROM (SELECT doc_id, h, unnest(range(0, n - 99, 256)) AS base FROM d WHERE n >= 100)),
win AS (SELECT doc_id, base + j AS k, md5_number(substr(p, 2 * j + 1, 200)) AS s
        FROM (SELECT doc_id, base, p, unnest(range(0, least(256, strlen(p) // 2 - 99))) AS j FROM piece)),
first AS (SELECT s, min({'doc': doc_id, 'at': k}) AS f FROM win GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, k, k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 AS apart
           FROM win JOIN first ON first.s = win.s WHERE f < {'doc': doc_id, 'at': k}),
span AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b
         FROM (SELECT doc_id, k, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM starts) GROUP BY doc_id, run),
edge AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT span.doc_id, max(b), any_value(n) FROM span JOIN d ON d.doc_id = span.doc_id GROUP BY span.doc_id),
cut AS (SELECT e.doc_id, string_agg(substr(h, 2 * e.a + 1, 2 * (e.b - e.a)), '' ORDER BY e.a) AS t
        FROM edge e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

OP11 = r"""
WITH l AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS p
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
gone AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, p, line, keeper IS NOT NULL AND l.doc_id <> keeper AS dropped FROM l LEFT JOIN gone ON gone.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP12 = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda s: CAST(ascii(s) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc),
own AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
          strlen(coalesce(text, '')) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
        FROM conversations WHERE conv_id IS NOT NULL),
both_parts AS (SELECT h.conv_id, 0 AS part, k, d, b FROM h JOIN own ON own.conv_id = h.base AND k <= h
          UNION ALL SELECT h.conv_id, 1, k, d, b FROM h JOIN own ON own.conv_id = h.conv_id AND k > h),
turns AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path, b
          FROM both_parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)),
members AS (SELECT conv_id, depth, path, b FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
         FROM (SELECT conv_id, max(path) AS path FROM members GROUP BY conv_id) GROUP BY path),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
            substr(path, 1, 32 * (CAST(depth AS INT) - 1)) AS above FROM members GROUP BY path, depth),
kids AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
under AS (SELECT substr(path, 1, 32 * CAST(d AS INT)) AS path, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * b) AS saved
          FROM (SELECT nodes.path, n_convs, b, kids.n IS NULL AS leaf, unnest(range(0, depth + 1)) AS d
                FROM nodes LEFT JOIN kids ON kids.above = nodes.path) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n JOIN under ON under.path = n.path LEFT JOIN kids ON kids.above = n.path LEFT JOIN ends ON ends.path = n.path
LEFT JOIN nodes p ON p.path = n.above AND n.depth > 0
"""
