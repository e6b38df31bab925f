"""DuckDB SQL that must give the rows of those queries that SQL can express, by plain means over whole tables."""

from __future__ import annotations

from quorana.llm import mixing

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(l.l) AS n_lines, len(list_filter(w.w, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) AS n_shouted FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_shouted > 25 * n_words OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept FROM b"""

NEAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v)
SELECT s.doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id"""

LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
c AS (SELECT * FROM l WHERE length(line) >= 6 OR regexp_matches(line, '[\p{L}\p{N}]')), f AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM c GROUP BY line), q AS (SELECT * FROM f WHERE n >= 6),
k AS (SELECT line, n, first, unnest([n || 'a' || left(line, n // 2), n || 'b' || substr(line, n // 2 + 1), (n - 1) || 'a' || left(line, (n - 1) // 2), (n - 1) || 'b' || right(line, (n - 1) - (n - 1) // 2)]) AS key FROM q),
near AS (SELECT DISTINCT b.line FROM k a JOIN k b ON a.key = b.key AND a.first < b.first AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.line, b.line) <= 1),
g AS (SELECT doc_id, no FROM c JOIN f USING (line) WHERE (doc_id, no) > first OR line IN (SELECT line FROM near)), t AS (SELECT doc_id, count(*) AS n, string_agg(no::VARCHAR, ',' ORDER BY no) AS r FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(t.n, 0)::BIGINT AS n_removed, coalesce(t.r, '') AS removed_lines FROM documents LEFT JOIN t USING (doc_id)"""

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 99)) AS pos, h FROM d WHERE n >= 100), s AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) AS k FROM p),
r AS (SELECT doc_id, pos FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1), o AS (SELECT doc_id, pos, coalesce(max(pos + 100) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS upto FROM r),
i AS (SELECT doc_id, pos, sum((pos > upto)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o), u AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM u UNION ALL SELECT doc_id, max(b), NULL FROM u GROUP BY doc_id UNION ALL SELECT doc_id, 0, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM u)),
x AS (SELECT k.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id), c AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS runs FROM u GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)"""

SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE_SQL, "op5_quality": QUALITY, "op7_near_dups": NEAR, "op9_lines": LINES, "op10_substrings": SUBSTRINGS}
