"""SQL counterparts (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from flowlens.llm.chat import CONTROL, MARKS
from flowlens.llm.rules import STOP_WORDS, THRESHOLDS

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACED = r"[^\x20\x09-\x0D]+"


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP2 = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_SPACED}') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OPEN = " ".join(f"WHEN '{role}' THEN '{mark}'" for role, mark in MARKS.items())
OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(CASE role {_OPEN} ELSE '[ROLE:' || role || '] ' END) + length({_escaped("text")}) + 4))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5 = f"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS s, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ALNUM}') AS w FROM documents),
size AS (SELECT DISTINCT k FROM win),
place AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM doc, size WHERE len(w) >= k),
hit AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM place) p JOIN win USING (k, s)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

_METRICS = {
    "mean_word": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "bangs_per_word": "n_bangs / nullif(n_words, 0)",
    "stop_words": "stop_words",
    "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "letter_share": "1 - n_other / nullif(word_chars, 0)",
}
_LIMITS = " AND ".join(f"coalesce({_METRICS[m]} {sign} {limit}, false)" for m, least, most in THRESHOLDS for sign, limit in ((">=", least), ("<=", most)) if limit is not None)
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP9 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
place AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM place) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM again) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS l, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '[\\x00-\\x60\\x7B-\\x7F]+')), [{_STOPS}])) AS stop_words,
    len(regexp_extract_all(t, '!')) AS n_bangs, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0DA-Za-z\\x{{80}}-\\x{{10FFFF}}]')) AS n_other
  FROM t LEFT JOIN rep USING (doc_id)),
all_counts AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_LIMITS} AS kept FROM all_counts
"""

ORACLE = {"op2_ngram_jaccard": OP2, "op4_chat_format": OP4, "op5_decontamination": OP5, "op9_quality_rules": OP9}
