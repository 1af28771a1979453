"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import language, mixing, near_dedup, packing, ppm, quality_rules, sharding, token_files, tokens, topk

QUERIES = {
    "op1_range_coded_ids": token_files.op1_range_coded_ids,
    "op2_ppm_scores": ppm.op2_ppm_scores,
    "op3_temperature_mixing": mixing.op3_temperature_mixing,
    "op4_rule_ledger": quality_rules.op4_rule_ledger,
    "op5_whole_token_counts": tokens.op5_whole_token_counts,
    "op6_branch_and_bound": topk.op6_branch_and_bound,
    "op7_vector_best_fit": packing.op7_vector_best_fit,
    "op8_chosen_path_dedup": near_dedup.op8_chosen_path_dedup,
    "op9_best_fit_sharding": sharding.op9_best_fit_sharding,
    "op10_bayesian_language": language.op10_bayesian_language,
}

ORACLE_SQL = {
    "op4_rule_ledger": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d) x),
words AS (SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY k),
g AS (SELECT k, i, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d4, lead(word, 4) OVER o AS e, word AS a FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c, d4, e) AS n FROM g WHERE e IS NOT NULL),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM again WHERE n > 1) y GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) z WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN words USING (k) LEFT JOIN rep USING (k) LEFT JOIN l USING (k)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 40 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
""",
    "op8_chosen_path_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
    ELSE list_distinct([array_to_string(l[i : i + 4], ' ') FOR i IN range(1, len(l) - 3)]) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a AS f, b AS g FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS f, doc_id AS g FROM d UNION SELECT r.f, u.g FROM r JOIN u ON u.f = r.g),
m AS (SELECT f, min(g) AS c FROM r GROUP BY f)
SELECT doc_id, n::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON m.f = n.doc_id
""",
    "op6_branch_and_bound": r"""
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
