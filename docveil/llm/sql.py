"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

#: Rows, windows and lines are compared by their text here, where the query compares hashes.
QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, w FROM (
    SELECT doc_id, unnest(range(1, len(words) - 3)) AS i,
           unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS w
    FROM d WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (
  SELECT doc_id, host, text, lower(trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
         len(list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, host, text, unnest(lines) AS s FROM d)),
texts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
freq AS (
  SELECT host, line, first FROM (SELECT host, line, min(doc_id) AS first, count(DISTINCT text) AS n FROM ln GROUP BY host, line) JOIN texts USING (host)
  WHERE n > 5 AND 100 * n > 5 * texts),
lost AS (
  SELECT doc_id, sum(n) AS n FROM ln JOIN freq USING (host, line) WHERE doc_id <> first GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 10 * n_removed <= 7 * n_words AS kept
FROM base
"""

ORACLE: dict[str, str] = {"op7_quality_rules": QUALITY_RULES}
