"""DuckDB twins of the registered text queries that SQL can express."""

from __future__ import annotations

from lagwatch.llm import quality

# Fixed value: the white space that separates words, as in the operators.
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


ORACLE: dict[str, str] = {
    "op2_quality_rules": f"""
WITH base AS (
  SELECT doc_id, text, {_WORDS.format("text")} AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM base),
grams AS (
  SELECT doc_id, pos, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS gram,
         lead(w, 4) OVER o IS NOT NULL AS whole
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams WHERE whole) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(5, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 5)) AS step FROM twice)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, trim(line, {_WS}) AS bare, len({_WORDS.format("line")}) AS n
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
judged AS (
  SELECT doc_id, line,
    regexp_matches(bare, '{quality.SENTENCE_END}') AND {_count("line", quality.MARKS)} * 4 <= n
    AND {_count("line", quality.SHOUTS)} * 2 <= greatest(n, 4)
    AND NOT ({_count("line", quality.SEPARATORS)} >= 2 AND {_count("line", quality.SEPARATORS)} * 6 >= n)
    AND NOT (n <= 20 AND regexp_matches(line, '{quality.BOILERPLATE}')) AS passes
  FROM lines WHERE bare <> ''),
per_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars,
         coalesce(sum(length(line)) FILTER (passes), 0) AS kept_chars
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         {_count("coalesce(text, '')", quality.SYMBOLS)}::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN per_doc p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND kept_chars * 100 >= line_chars * 50 AS kept
FROM counted""",
    "op7_line_dedup": f"""
WITH split_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_WS}), {_FOLD}) AS k FROM split_lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (k IN (SELECT k FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                         FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""",
    "op13_fill_in_middle": """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
numbers AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
         ('0x' || h[25:32])::BIGINT AS h4
  FROM units),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2
  FROM numbers),
cut AS (
  SELECT *, array_to_string(u[1:c1], '') AS p, array_to_string(u[c1 + 1:c2], '') AS m, array_to_string(u[c2 + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut""",
}
