"""Equivalent SQL, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality_rules, secret_scan, substring_dedup, url_filter

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
), good AS (
  SELECT vec_id, label, e, norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND norm > 0 AND isfinite(norm) AND NOT list_contains(list_transform(e, lambda x: x IS NULL), true)
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(least(a, b)) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(l.m, v.vec_id)::BIGINT AS component_id, coalesce(v.vec_id = coalesce(l.m, v.vec_id), true) AS kept
FROM v LEFT JOIN degree d ON d.a = v.vec_id LEFT JOIN least l ON l.a = v.vec_id
"""

OP2 = f"""
WITH d0 AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, coalesce(length(text) - length(translate(text, '{mixing.SYMBOLS}', '')), 0) AS symbols,
    (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(2**52)}::DOUBLE AS u
  FROM documents
), d1 AS (SELECT *, least({mixing.SHARES - 1}, ceil(symbols * 4 / greatest(size, 1)))::INTEGER * {mixing.LENGTHS} + least({mixing.LENGTHS - 1}, length(size::VARCHAR) - (size = 0)::INTEGER) AS cell FROM d0),
model AS (SELECT cell, (sum(quality) + 1)::DOUBLE / (count(*) + 2) AS w FROM d1 JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY cell),
d AS (SELECT d1.*, coalesce(w, 0.5::DOUBLE) AS weight FROM d1 LEFT JOIN model ON d1.cell = model.cell), k AS (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS wt, (3 * source_size)::BIGINT AS cap FROM s),
p AS (
  SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS below_cap, coalesce(sum(wt) OVER o, 0)::BIGINT AS below_weight, (sum(source_size) OVER ())::BIGINT AS total, (sum(wt) OVER ())::BIGINT AS weights
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT *, (total - below_cap)::DOUBLE / (weights - below_weight) AS level FROM p),
water AS (SELECT arg_min(level, below_weight) AS water FROM l WHERE level <= cap::DOUBLE / wt),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR cap::DOUBLE / wt < water THEN cap::DOUBLE ELSE wt * water END AS target FROM l, water),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 1 END AS epochs FROM t),
b AS (SELECT *, target - epochs * source_size AS budget FROM e),
r AS (SELECT k.doc_id, k.size, b.*, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN budget > 0 AND before + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""


_CUT = "chr(57344)"  # a private-use character
OP5 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]+[ \\t\\r\\x0b\\x0c]+\\n?|\\n)', '\\1' || {_CUT}, 'g'), {_CUT}), lambda x: x <> '') AS pieces FROM documents
), p0 AS (SELECT r, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM d),
p1 AS (SELECT *, len(regexp_extract_all(piece, '[^\\x20\\x09-\\x0D]+')) AS n FROM p0),
p AS (SELECT *, (sum(n) OVER o)::BIGINT AS upto, (sum(length(piece)) OVER o)::BIGINT AS b FROM p1 WINDOW o AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)),
u AS (
  SELECT k.r, k.i, e.i AS last, k.b - length(k.piece) AS a, e.b, md5(array_to_string(d.words[k.upto - k.n + 1 : e.upto], ' ')) AS x, d.doc_id
  FROM p k JOIN p e ON k.r = e.r AND e.upto >= k.upto - k.n + {substring_dedup.UNIT_WORDS} AND e.upto - e.n < k.upto - k.n + {substring_dedup.UNIT_WORDS} JOIN d ON d.r = k.r WHERE k.n > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, r, i) AS rank FROM u),
gone AS (SELECT r, i, last, a, b FROM ranked WHERE rank > 1),
cut AS (SELECT r, i, piece, EXISTS (SELECT 1 FROM gone g WHERE g.r = p.r AND p.i BETWEEN g.i AND g.last) AS out FROM p),
left_over AS (SELECT r, coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT out), '') AS text, coalesce(sum(length(piece)) FILTER (WHERE out), 0)::BIGINT AS removed FROM cut GROUP BY r),
isle0 AS (SELECT *, a > max(b) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new FROM gone),
isle1 AS (SELECT *, count(*) FILTER (WHERE coalesce(new, true)) OVER (PARTITION BY r ORDER BY a ROWS UNBOUNDED PRECEDING) AS isle FROM isle0),
isle AS (SELECT r, min(a) AS a, max(b) AS b FROM isle1 GROUP BY r, isle),
spans AS (SELECT r, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM isle GROUP BY r),
sizes AS (SELECT r, count(*) AS n_units FROM u GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text, coalesce(l.removed, 0)::BIGINT AS removed, coalesce(s.spans, '') AS spans, coalesce(n_units, 0)::BIGINT AS n_units
FROM d LEFT JOIN left_over l USING (r) LEFT JOIN spans s USING (r) LEFT JOIN sizes USING (r)
"""


def _host(c: str) -> str:
    return f"coalesce(translate(regexp_extract(CASE WHEN strpos({c}, '://') > 0 THEN substr({c}, strpos({c}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '')"


def _path(c: str) -> str:
    return f"coalesce(regexp_extract(CASE WHEN strpos({c}, '://') > 0 THEN substr({c}, strpos({c}, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '')"


def _query(c: str) -> str:
    return f"coalesce(regexp_extract(CASE WHEN strpos({c}, '://') > 0 THEN substr({c}, strpos({c}, '://') + 3) ELSE '' END, '^[^?#]*(\\?[^#]*)', 1), '')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"({_q(v)}, {_q(h)}, {_q(p)})" for v, h, p in url_filter.RULES)
_U = url_filter
_TAG = r"(?is)<(?:link|meta)\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*>"
_SCHEMED = f"regexp_matches(ref, {_q(_U.SCHEME)})"


def _decode(c: str) -> str:
    number = "CASE WHEN r[3] IN ('x', 'X') THEN ('0x' || r[4 : len(r) - 1])::BIGINT ELSE r[3 : len(r) - 1]::BIGINT END"
    out = f"list_reduce(list_prepend({c}, regexp_extract_all({c}, {_q(_U.NUMERIC)})), lambda acc, r: CASE WHEN {number} BETWEEN 1 AND 127 THEN replace(acc, r, chr(({number})::INTEGER)) ELSE acc END)"
    for name, value in _U.NAMED.items():
        out = f"replace({out}, {_q(name)}, {_q(value)})"
    return out


def _attribute(name: str) -> str:
    raw = f"list_filter(attrs, lambda a: lower(regexp_extract(a, '^[^\\s=]+')) = '{name}')[1]"
    return "coalesce(" + " || ".join(f"regexp_extract({raw}, {_q(_U.VALUE)}, {k})" for k in (1, 2, 3)) + ", '')"


OP6 = f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {_RULES}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, {_q(_U.NO_TAGS)}, ' ', 'g'), {_q(_TAG)})) AS tag FROM pages WHERE url IS NOT NULL),
attributed AS (SELECT url, regexp_extract_all(tag, {_q(_U.ATTRIBUTE)}) AS attrs FROM tags),
raw AS (
  SELECT url, lower(attrs[1]) AS tag, {_attribute('rel')} AS rel0, {_attribute('href')} AS href0, {_attribute('http-equiv')} AS equiv0, {_attribute('content')} AS content0 FROM attributed
), plain AS (SELECT url, tag, {_decode('rel0')} AS rel, {_decode('href0')} AS href, {_decode('equiv0')} AS equiv, {_decode('content0')} AS content FROM raw),
refs AS (
  SELECT url, regexp_replace(CASE WHEN tag = '<link' AND list_contains(string_split_regex(lower(rel), '\\s+'), 'canonical') THEN href
    WHEN tag = '<meta' AND trim(lower(equiv)) = 'refresh' THEN {' || '.join(f"coalesce(regexp_extract(content, {_q(_U.REFRESH)}, {k}), '')" for k in (1, 2, 3))} END, '^\\s+|\\s+$|[\\t\\r\\n]', '', 'g') AS ref FROM plain
), parts AS (SELECT *, regexp_extract(url, '^([^:]*):', 1) AS scheme, {_host('url')} AS h, {_path('url')} AS pth, regexp_replace({_path('url')}, '[^/]*$', '') AS folder FROM refs WHERE ref <> ''),
targets AS (SELECT url, target FROM (
  SELECT url, CASE WHEN {_SCHEMED} THEN CASE WHEN regexp_matches(ref, {_q(_U.SCHEME + '//')}) THEN ref END WHEN h = '' OR starts_with(ref, '#') THEN NULL
    WHEN starts_with(ref, '//') THEN scheme || ':' || ref WHEN starts_with(ref, '/') THEN scheme || '://' || h || ref WHEN starts_with(ref, '?') THEN scheme || '://' || h || pth || ref
    ELSE scheme || '://' || h || CASE WHEN folder = '' THEN '/' ELSE folder END || ref END AS target FROM parts) WHERE target IS NOT NULL
), urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM targets),
named AS (SELECT url, {_host('url')} AS host, {_path('url')} AS path, {_query('url')} AS query FROM urls),
dotless AS (
  SELECT url, host, query, path, CASE WHEN path = '' THEN '/' WHEN strpos(path, '/.') > 0 THEN array_to_string(list_reduce(list_transform(string_split(CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN path || '/' ELSE path END, '/'), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1 : greatest(len(acc) - 1, 1)] ELSE list_concat(acc, x) END), '/') ELSE path END AS clean FROM named
),
fits AS (
  SELECT n.url, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM named n JOIN rules r ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath) GROUP BY n.url
), nodes AS (SELECT n.url, CASE WHEN host <> '' THEN host || clean || query END AS node, host, path, rule, verdict FROM dotless n LEFT JOIN fits f ON f.url = n.url),
edge AS (
  SELECT a.node AS a, b.node AS b FROM targets t JOIN nodes a ON a.url = t.url JOIN nodes b ON b.url = t.target WHERE a.node <> b.node
  UNION SELECT b.node, a.node FROM targets t JOIN nodes a ON a.url = t.url JOIN nodes b ON b.url = t.target WHERE a.node <> b.node
), reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
classes AS (SELECT r.a AS node, bool_or(coalesce(n.verdict = 'block', false)) AS blocked, bool_or(coalesce(n.verdict = 'allow', false)) AS cleared FROM reach r JOIN nodes n ON n.node = r.b GROUP BY r.a)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule,
  coalesce(n.verdict, CASE WHEN c.blocked AND NOT c.cleared THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN nodes n ON n.url = p.url LEFT JOIN classes c ON c.node = n.node
"""

_Q = quality_rules
OP8 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
each AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (
  SELECT r, i, n, array_to_string(ws, ' ') AS x FROM (
    SELECT w.r, i, n, words[i : i + n - 1] AS ws FROM w, (VALUES ({_Q.WINDOW}), ({_Q.MIN_REPEAT}), ({_Q.MAX_REPEAT + 1})) sizes(n), unnest(range(1, len(words) - n + 2)) u(i))
), again AS (SELECT *, count(*) OVER (PARTITION BY r, n, x) AS c FROM win),
hit AS (SELECT DISTINCT r, n, i + k AS i FROM again, unnest(range(0, n)) o(k) WHERE c > 1 AND n <= {max(_Q.WINDOW, _Q.MIN_REPEAT)}),
cover AS (SELECT r, count(*) FILTER (WHERE n = {_Q.WINDOW}) AS rep, count(*) FILTER (WHERE n = {_Q.MIN_REPEAT}) AS cov FROM hit GROUP BY r),
far AS (SELECT DISTINCT r FROM again WHERE n = {_Q.MAX_REPEAT + 1} AND c > 1),
chars AS (SELECT r, sum(length(word)) AS word_chars FROM each GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
j AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep, 0)::BIGINT AS n_repeat_words, coalesce(cov, 0)::BIGINT AS covered_words, far.r IS NOT NULL AS too_long
  FROM w LEFT JOIN chars USING (r) LEFT JOIN lines USING (r) LEFT JOIN cover USING (r) LEFT JOIN far ON far.r = w.r
), b AS (SELECT *, n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed, NOT base_failed AND covered_words <= {_Q.MAX_COVERED} * n_words AND NOT too_long AS kept FROM b
"""

_S = secret_scan


def _spans(name: str, pattern: str) -> str:
    return f"""{name} AS (
  SELECT r, (sum(length(gap)) OVER o + coalesce(sum(length(value)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, value
  FROM (SELECT r, unnest(regexp_extract_all(text, {_q(pattern)})) AS value, unnest(regexp_split_to_array(text, {_q(pattern)})[1 : len(regexp_extract_all(text, {_q(pattern)}))]) AS gap, unnest(range(1, len(regexp_extract_all(text, {_q(pattern)})) + 1)) AS i FROM w)
  WINDOW o AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING))"""


OP10 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_spans('a', _S.ASSIGN)}, {_spans('c', _S.ACCESS)}, {_spans('h', _S.HEX)}, {_spans('t', _S.TOKEN)},
base AS (
  SELECT r, 0 AS rank, 'assign' AS kind, start, start + length(value) AS stop FROM a WHERE length(regexp_extract(value, {_q(_S.ASSIGN)}, 2)) >= 8
  UNION ALL SELECT r, 1, 'access', start, start + length(value) FROM c UNION ALL SELECT r, 2, 'hex', start, start + length(value) FROM h
), scored AS (
  SELECT r, start, start + length(value) AS stop,
    list_sum(list_transform(range(1, length(value)), lambda i: ratios[(strpos({_q(_S.ALPHABET)}, value[i]) - 1) * {len(_S.ALPHABET)} + strpos({_q(_S.ALPHABET)}, value[i + 1])])) / (length(value) - 1) AS llr
  FROM t, (SELECT [{', '.join(f'{x}::DOUBLE' for x in _S.model())}] AS ratios)
), random AS (SELECT r, 3 AS rank, 'random' AS kind, start, stop FROM scored s WHERE llr >= {_S.THRESHOLD} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s.stop AND s.start < b.stop)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM random),
made AS (
  SELECT r, count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2, count(*) FILTER (WHERE rank = 3) AS n3,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE rank < 3) AS fixed, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS whole
  FROM spans GROUP BY r
)
SELECT w.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(fixed, '')) AS base_sha256, coalesce(whole, '') AS spans, coalesce(n3, 0)::BIGINT AS n_random
FROM w LEFT JOIN made USING (r)
"""

ORACLE_SQL = {"op1_pivot_permutation": OP1, "op2_mixing": OP2, "op5_substring_dedup": OP5, "op6_url_filter": OP6, "op8_quality_rules": OP8, "op10_secret_scan": OP10}
