"""The queries' results in SQL, for the operators that SQL can express."""

from __future__ import annotations

from . import linededup, mixing, quality

W = r"[^\x20\x09-\x0D]+"
S = r"[\x20\x09-\x0D]"

MIXING = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY 1), w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS wt, 3.0::DOUBLE * s AS cap FROM t),
l AS (SELECT *, ((SELECT sum(s) FROM t)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
g AS (SELECT source, s, least(cap, max(lv) OVER () * wt) AS target FROM l), b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM g), e AS (SELECT *, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS ep FROM b),
r AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, size, s AS source_size, target, CAST(ep * size + greatest(0, least(size, budget - ep * s - before)) AS BIGINT) AS taken FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source"""

MINHASH = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, i, n, w || CASE WHEN n > 1 THEN ' ' || coalesce(lead(w, 1) OVER o, '') ELSE '' END || CASE WHEN n > 2 THEN ' ' || coalesce(lead(w, 2) OVER o, '') ELSE '' END AS sh FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, sh FROM k WHERE i <= greatest(1, n - 2)), c AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS z FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * z >= 85 * (a.m + b.m - z)), f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
q AS (WITH RECURSIVE r(v, c) AS (SELECT DISTINCT x, x FROM f UNION SELECT f.y, r.c FROM r JOIN f ON f.x = r.v) SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(m, 0) AS n_shingles, coalesce(q.c, d.doc_id) AS component_id, coalesce(q.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN q ON q.v = d.doc_id"""

EXACT = f"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS l, regexp_replace(coalesce(text, ''), '{S}', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY l DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k"""

LINES = rf"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '{linededup.SOFT_LINE_SQL}')) AS t, generate_subscripts(regexp_extract_all(text, '{linededup.SOFT_LINE_SQL}'), 1) AS i FROM documents WHERE length(text) > 0),
g AS (SELECT *, md5(coalesce(lag(t) OVER o, '') || t) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, i > 1 AND i < n - 1 AND r < lag(r) OVER o AND r < lead(r) OVER o AS cut FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(sum(CAST(coalesce(cut, false) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM c),
k AS (SELECT doc_id, place, string_agg(t, '' ORDER BY i) AS t FROM p GROUP BY 1, 2),
f AS (SELECT *, len(regexp_extract_all(t, '{W}')) AS w, row_number() OVER (PARTITION BY t ORDER BY doc_id, place) AS seen FROM k),
e AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM f WHERE seen > 1),
x AS (SELECT doc_id, place, w, sum(w) OVER (PARTITION BY doc_id, run) AS rw FROM e), r AS (SELECT * FROM x WHERE rw >= {linededup.MIN_WORDS}),
m AS (SELECT k.doc_id, count(r.place) AS n_removed, CAST(coalesce(sum(r.w), 0) AS BIGINT) AS removed_words, coalesce(string_agg(CASE WHEN r.place IS NULL THEN k.t END, '' ORDER BY k.place), '') AS t FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.place = k.place GROUP BY 1)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_words, 0) AS removed_words, CASE WHEN text IS NOT NULL THEN coalesce(length(t), 0) END AS clean_chars, sha256(coalesce(t, '')) AS clean_sha256 FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"""

QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), u AS (SELECT doc_id, unnest(regexp_extract_all(t, '{W}')) AS w, generate_subscripts(regexp_extract_all(t, '{W}'), 1) AS i FROM d),
k AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS k, lead(w, 7) OVER o AS last FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k WHERE last IS NOT NULL), c AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM h WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT x) AS dups FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{W}') GROUP BY 1),
m AS (SELECT d.doc_id, source, len(regexp_extract_all(t, '{W}')) AS n_words, length(regexp_replace(t, '{S}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines, 0) AS n_lines, coalesce(dups, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines AS any_failed FROM b),
s AS (SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS f FROM a GROUP BY 1), v AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v, avg(1 / n) AS inv FROM s),
q AS (SELECT m, CASE WHEN v IS NULL OR m <= 0 OR m >= 1 THEN 1.0 WHEN v - m * (1 - m) * inv <= 0 THEN {quality.MOST_STRENGTH} ELSE least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1.0), {quality.MOST_STRENGTH}) END AS st FROM v), y AS (SELECT source, (f + m * st) / (n + st) AS rate FROM s, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > {quality.HOST_LIMIT} AND any_failed) AS kept, round(rate, 9) AS host_rate FROM a JOIN y ON a.source IS NOT DISTINCT FROM y.source"""

ORACLES = {"op2_mixing": MIXING, "op6_minhash": MINHASH, "op7_exact_dedup": EXACT, "op9_line_dedup": LINES, "op10_quality": QUALITY}
