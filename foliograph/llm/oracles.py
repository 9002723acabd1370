"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM t)
"""

OP2 = WORDS + r"""
, p AS (SELECT doc_id, k, len(ws) AS n, ws[k : k + 4] AS w5, ws[k : k + 7] AS w8, ws[k : k + 60] AS w61 FROM w),
r AS (SELECT doc_id, k, n, k + 4 <= n AND count(*) OVER (PARTITION BY doc_id, w5) > 1 AS r5, k + 7 <= n AND count(*) OVER (PARTITION BY doc_id, w8) > 1 AS r8,
  k + 60 <= n AND count(*) OVER (PARTITION BY doc_id, w61) > 1 AS r61 FROM p),
c AS (SELECT doc_id, bool_or(r5) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5, bool_or(r8) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8, r61 FROM r),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (c5) AS n_repeat_words, count(*) FILTER (c8) AS covered_words, bool_or(r61) AS long FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, CAST(sum(m - 1) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS m FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
a AS (SELECT t.doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(long, FALSE) AS long FROM t LEFT JOIN s USING (doc_id) LEFT JOIN d USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * covered_words <= 20 * n_words AND NOT long AS kept, covered_words FROM a
"""

OP3 = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT DISTINCT doc_id, hash(ws[k : k + 4]) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS k FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP8 = WORDS + r"""
, p AS (SELECT doc_id, k, len(ws) AS n, ws[k] AS word, CASE WHEN k + 19 <= len(ws) THEN array_to_string(ws[k : k + 19], ' ') ELSE doc_id || chr(10) || k END AS win FROM w),
r AS (SELECT doc_id, k, n, word, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1 AS later FROM p),
c AS (SELECT doc_id, k, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL = {"op2_suffix_repetition": OP2, "op3_prefix_tree_join": OP3, "op8_count_min_substrings": OP8}
