"""DuckDB SQL of the training-data queries that SQL can express.

Words are cut with regular expressions, windows are lists, near duplicates a self-join on shared
n-grams with a recursive closure: plain definitions, written apart from the operators.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SOLID = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_SOLID}) AS w FROM documents),
s AS (SELECT DISTINCT r, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS g FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(e.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN reach ON reach.a = d.r LEFT JOIN d e ON e.r = reach.b GROUP BY d.r, d.doc_id
"""

QUALITY = f"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, text IS NULL AS none FROM documents),
d AS (SELECT *, min(r) OVER (PARTITION BY doc_id, host, text, none) AS doc FROM d0),
w AS (SELECT *, regexp_extract_all(text, {_SOLID}) AS w FROM d),
g AS (SELECT r, generate_subscripts(gs, 1) AS i, unnest(gs) AS g FROM (SELECT r, [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] AS gs FROM w WHERE len(w) >= 5)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT r, doc, host, line, regexp_extract_all({_LOWER.replace("coalesce(text, '')", 'line')}, {_SOLID}) AS lw FROM (SELECT r, doc, host, unnest(string_split(text, chr(10))) AS line FROM d)),
k AS (SELECT r, doc, host, line, array_to_string(lw, ' ') AS key, len(lw) AS n FROM l WHERE len(lw) > 0),
u AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM k GROUP BY r),
f AS (SELECT host, key, count(DISTINCT doc) AS docs FROM k GROUP BY host, key),
t AS (SELECT host, count(DISTINCT doc) AS total FROM d GROUP BY host),
q AS (SELECT host, key FROM f JOIN t USING (host) WHERE docs > 20 AND (docs > 0.01 * total OR docs > 1000)),
x AS (SELECT r, sum(n) AS gone FROM k JOIN q USING (host, key) GROUP BY r),
b AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(x.gone, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN u USING (r) LEFT JOIN c USING (r) LEFT JOIN x USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM b
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
m AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
v AS (SELECT DISTINCT item, unnest([w[i:i + 7] FOR i IN range(1, greatest(len(w) - 7, 1) + 1)]) AS g FROM m WHERE len(w) > 0),
z AS (SELECT DISTINCT len(g) AS n FROM v),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, z WHERE len(w) >= n),
h AS (SELECT p.r, p.i, p.n, v.item FROM p JOIN v ON v.g = p.w[i:i + n - 1]),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
e AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN e USING (r)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS rank, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rank, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS text FROM d),
w AS (SELECT doc_id, rank, k, regexp_extract_all({_LOWER}, {_SOLID}) AS w FROM l),
s AS (SELECT doc_id, rank, k, w, len(w) AS n FROM w WHERE len(w) > 0),
f AS (SELECT w, n, min(struct_pack(r := rank, k := k)) AS pos FROM s GROUP BY w, n),
v AS (SELECT w, n, pos, j, list_concat(list_slice(w, 1, j - 1), list_slice(w, j + 1, n)) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM f WHERE n >= 5)),
a AS (SELECT v, j, min(pos) AS pos FROM v GROUP BY v, j),
g AS (SELECT v, min(pos) AS pos FROM v GROUP BY v),
c AS (SELECT v.w, a.pos FROM v JOIN a ON a.v = v.v AND a.j = v.j UNION ALL SELECT v.w, f.pos FROM v JOIN f ON f.w = v.v WHERE f.n >= 5 UNION ALL SELECT f.w, g.pos FROM f JOIN g ON g.v = f.w WHERE f.n >= 5),
b AS (SELECT f.w, f.pos, min(c.pos) FILTER (c.pos < f.pos) AS near FROM f LEFT JOIN c ON c.w = f.w GROUP BY f.w, f.pos)
SELECT s.doc_id, CAST(s.k AS INTEGER) AS line_no, CAST(s.n AS INTEGER) AS n_words, CASE WHEN near IS NULL THEN 0 ELSE 1 END AS edits,
  nullif(coalesce(near, pos).r, 9223372036854775807) AS first_doc_id, CAST(coalesce(near, pos).k AS INTEGER) AS first_line_no
FROM s JOIN b ON b.w = s.w WHERE near IS NOT NULL OR struct_pack(r := s.rank, k := s.k) > pos
"""
