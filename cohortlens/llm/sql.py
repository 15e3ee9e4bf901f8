"""DuckDB texts of the queries that SQL expresses, written from the definitions.

Without a text are: the learners and scores (co-training, context trees, mixing rates), tiling, DOM alignment, regular
expression rules with suppression, the k-d tree (no CRC-32 in DuckDB) and the byte strings of the suffix dedup (too slow over
whole tables), token counts and alignments (the tokenizers' merges) and importance weights (CRC-32 again); tests/llm compares those with brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM sizes
  UNION
  SELECT s.b, reach.r FROM reach JOIN sides s ON s.a = reach.doc_id WHERE reach.r < s.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)
"""

_QUALITY = rf"""
WITH base AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM base, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, unnest(l) AS line FROM base),
keyed AS (
  SELECT doc_id, host, md5(text) AS t, length(line) AS chars,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
         CAST('0x' || substr(md5(trim(regexp_replace(regexp_replace(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'),
           '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), 1, 15) AS BIGINT) AS key FROM lines),
bodies AS (SELECT host, t, max(struct_pack(chars := chars, key := key)).key AS body FROM keyed GROUP BY host, t),
places AS (SELECT DISTINCT host, key, t FROM keyed),
frequent AS (
  SELECT host, key FROM places JOIN bodies USING (host, t) GROUP BY host, key
  HAVING count(*) >= 20 AND 2 * count(DISTINCT body) >= count(*)),
removed AS (
  SELECT doc_id, count(*) AS n, sum(words) AS words FROM keyed JOIN frequent USING (host, key) GROUP BY doc_id),
counts AS (
  SELECT base.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_lines, CAST(coalesce(removed.words, 0) AS BIGINT) AS removed_words
  FROM base LEFT JOIN repeated ON base.doc_id = repeated.doc_id LEFT JOIN removed ON base.doc_id = removed.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR 100 * (n_words - removed_words) < 30 * n_words)) AS kept
FROM counts
"""

ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": _JACCARD, "op10_line_frequency": _QUALITY}
