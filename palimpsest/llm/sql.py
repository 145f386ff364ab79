"""The oracle's SQL for the queries that SQL can express over the given tables."""

from __future__ import annotations

from . import quality as Q

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: op6: windows of 13 words, the least document of each, and the words that later ones lose.
SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS m FROM win GROUP BY g) f USING (g) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (g.p IS NULL) AS text FROM word LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = f"regexp_extract_all({ASCII}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: op10: windows of ten words of the items (one shorter for an item of fewer words) found in the documents.
LEAKS = f"""WITH d AS (SELECT doc_id, {PLAIN} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(ws) >= n)),
hit AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(range(0, n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


def distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]')} + {part('z[2]')})) / 2, 0))"


# Java's classes in RE2: the same letters and digits for the languages at hand.
COUNTS = ", ".join(f"CAST(len(regexp_extract_all(t, '{p}')) AS DOUBLE)" for p in [*list(Q.CLASSES.values())[:-1], "[^\\p{L}\\p{Nd}\\x09-\\x0D\\x20.,;:!?]"])

#: op5: counts of each text, profiles of its language or of all, and the verdict.
QUALITY = f"""WITH large AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING sum(len({WORDS})) >= {Q.PROFILE_WORDS}),
w AS (SELECT d.* EXCLUDE (lang), coalesce('+' || large.lang, '-') AS lang, coalesce(text, '') AS t, {WORDS} AS ws FROM documents d LEFT JOIN large ON d.lang = large.lang),
ww AS (SELECT lang, ws FROM w WHERE lang <> '-' UNION ALL SELECT '-', ws FROM w),
c AS (SELECT *, list_concat(five, [length(t) - list_sum(five)]) AS cls, CAST(len(ws) AS BIGINT) AS n FROM (SELECT *, [{COUNTS}] AS five FROM w)),
lang AS (SELECT lang, coalesce(sum(n), 0) AS ln, [{", ".join(f"sum(cls[{i}])" for i in range(1, len(Q.CLASSES) + 2))}] AS lcls FROM (SELECT lang, n, cls FROM c WHERE lang <> '-' UNION ALL SELECT '-', n, cls FROM c) GROUP BY lang),
top AS (SELECT lang, word, k, row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) AS rk FROM (SELECT lang, word, count(*) AS k FROM (SELECT lang, unnest(ws) AS word FROM ww) GROUP BY lang, word) JOIN lang USING (lang) WHERE k >= greatest(1, {Q.WORD_SHARE}::DOUBLE * ln)),
prof AS (SELECT lang, list(word ORDER BY rk) AS common, list(k / ln::DOUBLE ORDER BY rk) AS p FROM top JOIN lang USING (lang) WHERE rk <= {Q.TOP_WORDS} GROUP BY lang),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
rep AS (SELECT doc_id, count(*) AS n_repeat FROM (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1) x USING (doc_id, g), (SELECT unnest(range(0, 8)) AS k)) GROUP BY doc_id),
base AS (SELECT c.*, coalesce(n_repeat, 0) AS n_repeat, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM c LEFT JOIN rep USING (doc_id)),
judged AS (SELECT b.*, CASE WHEN length(t) >= {Q.MIN_CHARS} THEN {distance("list_transform(cls, lambda x: x / list_sum(cls))", "list_transform(lcls, lambda x: x / list_sum(lcls))")} END AS dc,
 CASE WHEN n >= {Q.MIN_WORDS} THEN {distance("list_concat(own, [1 - list_sum(own)])", "list_concat(p, [greatest(0, 1 - list_sum(p))])")} END AS dw
 FROM (SELECT base.*, lcls, p, list_transform(common, lambda r: len(list_filter(ws, lambda x: x = r)) / n::DOUBLE) AS own FROM base JOIN lang USING (lang) LEFT JOIN prof USING (lang)) b)
SELECT doc_id, n AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, n < 20 OR 100 * n_repeat > 30 * n AS base_failed,
 NOT (n < 20 OR 100 * n_repeat > 30 * n) AND coalesce(dc, 0) <= {Q.MAX_CLASS_DISTANCE}::DOUBLE AND coalesce(dw, 0) <= {Q.MAX_WORD_DISTANCE}::DOUBLE AS kept FROM judged"""


def scaled(scale: int, more: str = "") -> str:
    """The rows of embeddings that take part, their vectors in whole numbers."""
    return f"""v AS (SELECT row_number() OVER () AS k, vec_id{more}, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


#: op11: the 20 best of each row whose vec_id is divisible by 20.
TOP_K = f"""WITH {scaled(64)},
s AS (SELECT q.k AS q, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM s WINDOW o AS (PARTITION BY q ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20"""

#: op13: positives of each anchor, then the negatives of each positive's window.
NEGATIVES = f"""WITH {scaled(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label").rstrip(")")} AND label IS NOT NULL),
s AS (SELECT a.k AS a, a.vec_id AS anchor_id, c.k AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.k <> c.k WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score WINDOW o AS (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER o <= 10"""

NEXT = "CASE WHEN {0} = 2 THEN 3 ELSE 2 END"
NAME = "CASE WHEN {0} = 3 THEN 'assistant' ELSE 'user' END"

#: op12: states 0 (start), 1 (system), 2 (user), 3 (assistant); of each conversation, row and state the cheapest edits, least audit.
REPAIR = f"""WITH RECURSIVE tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
damage AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM conversations, tab),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM damage, range(2) x(n) WHERE d <> 0 AND (n = 0 OR d = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS ini, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS z FROM r),
f AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM n),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM f GROUP BY conv_id),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
rows AS (SELECT c, i, fault, ini, role, text FROM f JOIN ids ON f.conv_id IS NOT DISTINCT FROM ids.conv_id),
dp AS (SELECT c, 0::BIGINT AS i, 0 AS st, 0::BIGINT AS cost, '' AS audit, '' AS said FROM ids
 UNION ALL
 SELECT c, i, w.st, w.cost, w.audit, w.said FROM (
  SELECT c, i, unnest([{{'st': st, 'cost': cost + 3, 'audit': audit || 'D', 'said': said}},
    {{'st': CASE WHEN st = 0 AND ini = 's' THEN 1 WHEN st <> 2 AND ini = 'u' THEN 2 WHEN st = 2 AND ini = 'a' THEN 3 END, 'cost': cost + t, 'audit': audit || 'K', 'said': said || role || ':' || text || chr(10)}},
    {{'st': {NEXT.format("st")}, 'cost': cost + 2 + t, 'audit': audit || 'R', 'said': said || {NAME.format(f"({NEXT.format('st')})")} || ':' || text || chr(10)}}]) AS w, unnest(['D', 'K', 'R']) AS edit, fault
  FROM (SELECT dp.c, rows.i, fault, ini, role, text, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS t, CASE WHEN j = 0 THEN st WHEN j = 1 THEN {NEXT.format("st")} WHEN st = 2 THEN 2 ELSE 3 END AS st, cost + 2 * j AS cost, audit || repeat('I', j) AS audit,
    said || CASE WHEN j > 0 THEN {NAME.format(f"({NEXT.format('st')})")} || ':' || chr(10) ELSE '' END || CASE WHEN j > 1 THEN CASE WHEN st = 2 THEN 'user:' ELSE 'assistant:' END || chr(10) ELSE '' END AS said
   FROM dp JOIN rows ON dp.c = rows.c AND rows.i = dp.i + 1, (SELECT unnest([0, 1, 2]) AS j)))
 WHERE w.st IS NOT NULL AND (edit = 'D' OR fault NOT IN ('b', 'd')) QUALIFY row_number() OVER (PARTITION BY c, i, w.st ORDER BY w.cost, w.audit) = 1),
ended AS (SELECT c, cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit, said || CASE st WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END AS said
 FROM dp JOIN ids USING (c) LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE i = coalesce(m, 0) QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) = 1)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(CASE WHEN said = '' THEN '' ELSE left(said, length(said) - 1) END) AS repaired_sha256
FROM ended JOIN ids USING (c) LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id"""
