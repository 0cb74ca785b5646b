"""SQL twin of the quality-rule query."""
from __future__ import annotations

from tracesieve.llm.quality_rules import ALPHA, CAPITALS, DELTA, GRID, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, SYMBOLS

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _without(text: str, chars: str) -> str:
    return f"length(translate({text}, {chars}, ''))"


def _share(rule: str) -> str:
    counted, of = RULES[rule]
    return f"CASE WHEN {of} > 0 THEN {counted}::DOUBLE / {of} ELSE 0 END"


def quality_rules_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    rate = alpha / len(RULES)
    shares = "\nUNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {_share(r)} AS share FROM held" for r in RULES)
    grid = ", ".join(f"({i}, {g})" for i, g in enumerate(GRID))
    fired = " OR ".join(f"coalesce({_share(r)} > cut_{r}, false)" for r in RULES)
    base = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM docs, unnest(range(1, len(words) - 1)) AS r(i)
), repeated AS (
  SELECT doc_id, i FROM windows WINDOW w AS (PARTITION BY doc_id, a, b, c) QUALIFY count(*) OVER w > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM docs, unnest(string_split(t, chr(10))) AS l(line)
  WHERE {_without('line', _SPACES)} > 0 GROUP BY doc_id
), m AS MATERIALIZED (
  SELECT d.doc_id, stratum, len(words)::BIGINT AS n_words, {_without('t', _SPACES)}::BIGINT AS word_chars,
         (length(t) - {_without('t', f"'{SYMBOLS}'")})::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, (length(t) - {_without('t', f"'{CAPITALS}'")}) AS n_capitals,
         (length(t) - {_without('t', "'!'")}) AS n_shouts
  FROM docs d LEFT JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)
), held AS MATERIALIZED (
  SELECT * FROM m WHERE NOT {base} AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)
), shares AS ({shares}
), grid(i, cutoff) AS (VALUES {grid}
), counts AS MATERIALIZED (
  SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS k FROM shares, grid GROUP BY ALL
), tails AS MATERIALIZED (
  SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({rate}::DOUBLE) + (n - x) * ln(1 - {rate}::DOUBLE))) AS tail
  FROM (SELECT n, k, unnest(range(0, k + 1)) AS x FROM (SELECT DISTINCT n, k FROM counts WHERE k <= n * {rate})) GROUP BY n, k
), tests AS MATERIALIZED (
  SELECT stratum, rule, i, cutoff, coalesce(tail, 1) <= {delta / len(RULES)} / (SELECT count(DISTINCT stratum) FROM counts) AS fine
  FROM counts LEFT JOIN tails USING (n, k)
), upto AS MATERIALIZED (
  SELECT stratum, rule, coalesce(min(i) FILTER (NOT fine), {len(GRID)}) AS number FROM tests GROUP BY stratum, rule
), cutoffs AS MATERIALIZED (
  SELECT stratum, {", ".join(f"min(cutoff) FILTER (rule = '{r}' AND i < number) AS cut_{r}" for r in RULES)}
  FROM tests JOIN upto USING (stratum, rule) GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND NOT ({fired}) AS kept
FROM m LEFT JOIN cutoffs USING (stratum)
"""
