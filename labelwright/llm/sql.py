"""DuckDB SQL for the queries SQL can express: quality rules, line dedup and decontamination."""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, [x for x in regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') if x <> ''] AS words,
         [x for x in string_split(text, chr(10)) if trim(x, {_BLANK}) <> ''] AS lines
  FROM d),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, text, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_full_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR 2 * len(regexp_extract_all(text, '[A-Z][A-Z]')) > n_words
         OR word_chars < 2 * n_words OR word_chars > 25 * n_words
         OR (n_dup_lines >= 4 AND 10 * n_dup_lines > 6 * n_full_lines) AS rejected
  FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""

OP4 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, {_BLANK}), {_UPPER}, {_LOWER}) AS line_key FROM x),
r AS (
  SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS lost FROM k LEFT JOIN r ON k.line_key = r.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), {0}, {1}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')".format(_UPPER, _LOWER)

OP10 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
sized AS (SELECT item, words, least(13, len(words)) AS size FROM b WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS gram
  FROM (SELECT item, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
spans AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d JOIN sizes ON len(words) >= size)),
hits AS (SELECT doc_id, i, s.size, item FROM spans s JOIN windows w ON s.size = w.size AND s.gram = w.gram),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit_words ON d.doc_id = hit_words.doc_id LEFT JOIN hit_items ON d.doc_id = hit_items.doc_id
"""
